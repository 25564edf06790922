"""Surrogates in plain Python, one entity at a time, as a reference for the DataFrame expressions."""

import hashlib
from collections import defaultdict

import regex

from taxeval.llm import pii

FIND = regex.compile(pii.ANY)


def luhn_sum(digits):
    d = [int(c) for c in reversed(digits)]
    return sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def kind_of(e):
    if "@" in e:
        return "email"
    if regex.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", e):
        return "ip"
    if regex.match("[0-9A-Fa-f]{1,4}:", e):
        return "ipv6"
    if regex.match(r"[+(]|\d{3}-\d{3}-\d{4}$", e):
        return "phone"
    if regex.fullmatch(r"\d{3}-\d{2}-\d{4}", e):
        return "ssn"
    if regex.match(r"[A-Z]{2}\d{2}", e):
        return "iban"
    if e[0].isdigit():
        return "card" if luhn_sum(regex.sub("[^0-9]", "", e)) % 10 == 0 else None
    return "name"


def script_of(w):
    return "cyrillic" if regex.search(r"\p{Cyrillic}", w) else "greek" if regex.search(r"\p{Greek}", w) else "latin"


def phone_parts(e):
    m = regex.match(r"\+\d{1,3}(?=[ .(-])", e)
    return (m[0] if m else ""), e[len(m[0]) if m else 0 :]


def words_of(e):
    parts = e.split(" ")
    return [(w, 0 if i == 0 else 3 if w in pii.PARTICLES else 2 if i == len(parts) - 1 else 1) for i, w in enumerate(parts)]


def groups_of(e, kind):
    if kind == "email":
        return [[("mailbox", e.lower())], [("domain", e.rpartition("@")[2].lower())]]
    if kind == "phone":
        country, rest = phone_parts(e)
        return [[("phone", country + ":" + regex.sub("[^0-9]", "", rest))]]
    if kind in ("ssn", "card"):
        return [[(kind, regex.sub("[^0-9]", "", e))]]
    if kind == "iban":
        return [[("iban", e.replace(" ", ""))]]
    if kind == "ipv6":
        return [[("ipv6", e.lower())]]
    if kind == "name":
        title = e.split(" ")[0].removesuffix(".")
        gender = next((g for (g, _), ts in pii.TITLES.items() if title in ts), "n")
        of = lambda w, at: [(f"given-{gender}-{script_of(w)}", w.lower())] if at == 1 else [("family-" + script_of(x), x.lower()) for x in w.split("-")] if at == 2 else []
        return [of(w, at) for w, at in words_of(e)]
    return []


class Plain:
    def __init__(self, key):
        self.key = key

    def digest(self, *parts):
        return hashlib.sha256("|".join([self.key, *map(str, parts)]).encode()).hexdigest()

    def permuted(self, a, b, most_a, most_b, *tag):
        for i in range(pii.ROUNDS):
            f = lambda x, i=i: int(self.digest(*tag, i, x)[:15], 16)
            if i % 2 == 0:
                a = (a + f(b)) % most_a
            else:
                b = (b + f(a)) % most_b
        return a, b

    def permuted_digits(self, d, *tag):
        half = len(d) // 2
        a, b = self.permuted(int(d[:half]), int(d[half:]), 10**half, 10 ** (len(d) - half), *tag, len(d))
        return f"{a:0{half}d}{b:0{len(d) - half}d}"

    def shaped(self, text, h):
        out = []
        for i, c in enumerate(text):
            n = int(h[i % 31 * 2 : i % 31 * 2 + 4], 16)
            own = "0123456789" if c in "0123456789" else c
            for script, letters in pii.LETTERS.items():
                if own == c and regex.match(rf"(?=\p{{L}})\p{{{script}}}", c):
                    own = letters
            made = own[n % len(own)]
            out.append(made.upper() if regex.match(r"\p{Lu}", c) else made)
        return "".join(out)

    def of_atom(self, kind, value, attempt):
        h = self.digest(kind, attempt, value)
        more = h.translate(str.maketrans("abcdef", "012345"))
        more = more[len(more) - max(0, attempt - pii.SAME_LENGTH) :]
        if kind in ("phone", "ssn", "card"):
            country, _, rest = value.rpartition(":")
            digits = value[1:-1] if kind == "card" else rest
            number = self.permuted_digits(digits, kind + (country if kind == "phone" else ""), attempt) + more
            if kind != "card":
                return number
            number = value[0] + number
            return number + str((10 - luhn_sum(number + "0") % 10) % 10)
        if kind == "mailbox":
            return self.shaped(value.split("@")[0], h) + more
        if kind == "iban":
            bban = self.shaped(value[4:], h) + more
            return value[:2] + f"{98 - mod97(bban + value[:2] + '00'):02d}" + bban
        if kind == "domain":
            m = regex.search(r"\.(com|org|net)$", value)
            return "m" + h[: min(60, attempt + 10)] + ".example." + (m[1] if m else "com")
        if kind == "ipv6":
            first, colon, rest = value.partition(":")
            start = value[:4] if regex.match("f[cde]", value) else "2001"
            return start + "".join(c if c == ":" else h[i % 64] for i, c in enumerate(colon + rest))
        pick = lambda words, size: [words[int(h[5 * k : 5 * k + 5], 16) % len(words)] for k in range(size)]
        script = kind.split("-")[-1]
        names = pii.GIVEN.get((kind.split("-")[1], script)) if kind.startswith("given") else None
        return "-".join(pick(names, min(attempt, 11) + 1)) if names else "".join(pick(pii.SYLLABLES[script], min(attempt + 5, 12))).capitalize()

    def ip(self, e):
        o = [int(x) for x in e.split(".")]
        high = o[0] * 256 + o[1]
        own = next(((a, b) for a, b in pii.RESERVED if a <= high <= b), None)
        if own:
            x, y = self.permuted((high - own[0]) * 256 + o[2], o[3], (own[1] - own[0] + 1) * 256, 256, f"ip{own[0]}")
            first, last = own[0] + x // 256, x % 256 * 256 + y
        else:
            public = [h for h in range(65536) if not any(a <= h <= b for a, b in pii.RESERVED)]
            x, last = self.permuted(public.index(high), o[2] * 256 + o[3], len(public), 65536, "ip")
            first = public[x]
        return f"{first // 256}.{first % 256}.{last // 256}.{last % 256}"

    def of(self, e, kind, known):
        if kind is None:
            return e
        if kind == "ip":
            return self.ip(e)
        groups = [[known(a) for a in g] for g in groups_of(e, kind)]
        if kind == "name":
            word = lambda w, g: w if not g else "-".join(g).upper() if len(w) > 1 and w == w.upper() else "-".join(g)
            return " ".join(word(w, g) for (w, _), g in zip(words_of(e), groups, strict=True))
        one = groups[0][0]
        if kind == "email":
            local = e.split("@")[0]
            return "".join(c.upper() if i < len(local) and regex.match(r"\p{Lu}", local[i]) else c for i, c in enumerate(one)) + "@" + groups[1][0]
        if kind == "ipv6":
            return one
        start, rest = phone_parts(e) if kind == "phone" else ("", e)
        what = "[0-9A-Z]" if kind == "iban" else "[0-9]"
        left = iter(one)
        return start + regex.sub(what, lambda m: next(left), rest) + "".join(left)


def pseudonymized(texts, key):
    """The texts with surrogates; collisions are resolved over all atoms, one round after another."""
    plain = Plain(key)
    entities = {m[0] for t in texts for m in FIND.finditer(t or "")}
    atoms = {a for e in entities for g in groups_of(e, kind_of(e)) for a in g}
    attempt = dict.fromkeys(atoms, 0)
    made = {a: plain.of_atom(*a, 0) for a in atoms}
    space = lambda k, v: v.rpartition("@")[2] if k == "mailbox" else v.partition(":")[0] if k == "phone" else ""
    own = lambda k, v: v.split("@")[0] if k == "mailbox" else v.rpartition(":")[2] if k == "phone" else v
    taken = {(k, space(k, v), made_own) for k, v in atoms if k in pii.APART for made_own in [own(k, v)]}
    while True:
        groups = defaultdict(list)
        for (k, v), s in made.items():
            groups[k, space(k, v), s.lower()].append((attempt[k, v], v))
        bad = [(k, v) for (k, v), s in made.items() if min(groups[k, space(k, v), s.lower()])[1] != v or (k, space(k, v), s.lower()) in taken]
        if not bad:
            break
        for a in bad:
            attempt[a] += 1
            made[a] = plain.of_atom(*a, attempt[a])
    return [t and FIND.sub(lambda m: plain.of(m[0], kind_of(m[0]), made.__getitem__), t) for t in texts]

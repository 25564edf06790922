"""Secret scans with multipart credential linking.

Strong findings stand on their own. Weak candidates (identifiers, secrets, endpoints that also occur in plain text)
are reported only where a complementary part lies in their scope: an interval join of the parts of a text by role.
Each place of a text belongs to one part at most (base findings first, then named secrets, named identifiers,
endpoints, opaque strings), so a part never complements itself or what it lies in. Parts of a role are sorted, and the
nearest one to either side of a part is found by bisection: n log n, not all pairs. A text is one row, so the join
needs no shuffle. Each finding tells the nearest part of each other role, which links identifier, secret and endpoint.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, table

BASE = ("assign", "access", "hex")
LINKED = ("linked_id", "linked_secret", "linked_endpoint")
KINDS = BASE + LINKED
#: What each kind of finding is a part of a credential.
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "linked_id": "id", "linked_secret": "secret", "linked_endpoint": "endpoint"}
#: A scope: so many characters to either side of a candidate.
SCOPE = 160
ENTROPY = 3.5


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def named(words: tuple[str, ...], value: str) -> re.Pattern:
    """name, optional quote, : or =, optional quote, value; a name may follow on _ or -, but not on a letter or digit."""
    return re.compile("(?<![A-Za-z0-9])(?:" + "|".join(re.sub(r"_", "[_-]?", either_case(w)) for w in words) + r""")["']?\x20*[:=]\x20*["']?""" + f"({value})")


# The base patterns.
ASSIGN = re.compile("(?:" + "|".join(map(either_case, ("password", "passwd", "secret", "token"))) + "|" + either_case("api") + "_?" + either_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
HEX = re.compile("[0-9a-f]{24,}")

WEAK_ID = named(("access_key_id", "access_key", "key_id", "client_id", "app_id", "username", "user_name", "user", "login", "account"), r"[A-Za-z0-9._@+-]{3,}")
WEAK_SECRET = named(("secret_access_key", "client_secret", "secret_key", "private_key", "passphrase", "pass", "pwd", "auth", "credential", "signature"), r"[A-Za-z0-9+/_.=-]{6,}")
OPAQUE = re.compile("[A-Za-z0-9+/_-]{20,}={0,2}")
#: URLs, addresses, and host names with a port or of three labels or more.
ENDPOINT = re.compile(
    r"""[A-Za-z][A-Za-z0-9+.-]{1,11}://[^\s"'<>]+|(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?::\d{1,5})?(?![\w.])"""
    r"""|(?<![\w@.-])(?:(?:[A-Za-z0-9-]{1,63}\.){2,8}[A-Za-z]{2,24}(?::\d{1,5})?|(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}:\d{1,5})(?![\w-])"""
)


def opaque(value: str) -> bool:
    """Looks random: letters of both cases and digits, and high entropy."""
    if not (any(c.isdigit() for c in value) and any(c.islower() for c in value) and any(c.isupper() for c in value)):
        return False
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in (value.count(c) for c in set(value))) >= ENTROPY


class Parts:
    """Spans, sorted by start."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = sorted(spans)
        self.starts = [s for s, _ in self.spans]
        self.ends = list(accumulate((e for _, e in self.spans), max))
        self.last = list(accumulate(range(len(self.spans)), lambda i, k: k if self.spans[k][1] > self.spans[i][1] else i))

    def overlap(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end)
        return at > 0 and self.ends[at - 1] > start

    def nearest(self, start: int, end: int) -> tuple[int, int] | None:
        """The nearest span (the left one of equals) that ends before or begins after the interval, within the scope."""
        right = bisect_left(self.starts, end)
        left = bisect_right(self.starts, start) - 1  # spans that begin earlier; the one that ends last counts
        best = None
        if left >= 0 and start - SCOPE <= self.ends[left] <= start:
            best = (start - self.ends[left], self.spans[self.last[left]])
        if right < len(self.spans) and self.starts[right] - end <= SCOPE and (best is None or self.starts[right] - end < best[0]):
            best = (self.starts[right] - end, self.spans[right])
        return best[1] if best else None


def parts_of(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Base findings by kind, and the weak candidates by kind: these are apart from the base and from each other."""
    pairs = ":" in text or "=" in text
    base = {
        "assign": [m.span() for m in ASSIGN.finditer(text) if len(m[1]) >= 6] if pairs else [],
        "access": [m.span() for m in ACCESS.finditer(text)] if "AKIA" in text else [],
        "hex": [m.span() for m in HEX.finditer(text)],
    }
    opaques = [m.span() for m in OPAQUE.finditer(text) if opaque(m[0])]
    weak: dict[str, list[tuple[int, int]]] = {k: [] for k in LINKED}
    if pairs or opaques or any(base.values()):
        taken = [x for spans in base.values() for x in spans]
        for kind, spans in (
            ("linked_secret", [m.span(1) for m in WEAK_SECRET.finditer(text)] if pairs else []), ("linked_id", [m.span(1) for m in WEAK_ID.finditer(text)] if pairs else []),
            ("linked_endpoint", [m.span() for m in ENDPOINT.finditer(text)]), ("linked_secret", opaques),
        ):
            have = Parts(taken)
            new = [x for x in spans if not have.overlap(*x)]
            weak[kind] += new
            taken += new
    return base, weak


def scan_text(text: str) -> list[tuple[str, int, int, list[tuple[str, int, int]]]]:
    """(kind, start, end, parts) of all findings by start, then kind; parts: the nearest of each other role in the
    scope, as (role, start, end); none in texts without any secret. Code points, end exclusive."""
    base, weak = parts_of(text)
    of: dict[str, list[tuple[int, int]]] = {"id": [], "secret": [], "endpoint": []}
    for kind, spans in (base | weak).items():
        of[ROLE[kind]] += spans
    if not of["secret"]:
        return [(k, s, e, []) for s, k, e in sorted((s, k, e) for k, spans in base.items() for s, e in spans)]
    roles = {r: Parts(spans) for r, spans in of.items()}
    out = []
    for kind, spans in (base | weak).items():
        for s, e in spans:
            near = [(r, x) for r in roles if r != ROLE[kind] and (x := roles[r].nearest(s, e))]
            others = {r for r, _ in near}
            # An identifier needs a secret, a secret an identifier or endpoint, an endpoint both.
            if kind in BASE or (kind == "linked_id" and "secret" in others) or (kind == "linked_secret" and others) or (kind == "linked_endpoint" and {"id", "secret"} <= others):
                out.append((s, KINDS.index(kind), e, [(r, *x) for r, x in near]))
    return [(KINDS[k], s, e, near) for s, k, e, near in sorted(out)]


def scan_secrets(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default: all) and findings, an array of (kind, start, end, parts), in order; parts: the nearest
    complementary parts in the scope, as (role, start, end).

    Null and empty texts have no findings. Whole texts are scanned, whatever their length. An input column named
    findings, in any case of its letters, is replaced; nulls in other columns don't matter. Repeated rows are scanned
    like others; of spans at an equal distance the left one is the part; no rows: no rows.
    """
    number = lambda c: T.StructField(c, T.IntegerType())
    part = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), number("start"), number("end")]))
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), number("start"), number("end"), T.StructField("parts", part)]))

    def run(texts: pa.Array) -> list:
        return [[[{"kind": k, "start": s, "end": e, "parts": [{"role": r, "start": x, "end": y} for r, x, y in near]} for k, s, e, near in scan_text(t.as_py() or "")] for t in texts]]

    return arrow_map(docs, docs.columns if keep is None else keep, [text_col], [T.StructField("findings", kind)], run)


def query(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and links: each linked finding with the parts that go with it."""
    made = scan_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    text = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    parts = lambda x: F.array_join(F.transform(x["parts"], lambda p: F.concat_ws(":", p["role"], p["start"], p["end"])), "+")
    links = F.filter("findings", lambda x: F.size(x["parts"]) > 0)
    base = F.filter("findings", lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return made.select(
        "doc_id", *map(count, BASE), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("findings")).alias("spans"),
        F.concat_ws(",", F.transform(links, lambda x: F.concat(F.concat_ws(":", x["kind"], x["start"], x["end"]), F.lit(">"), parts(x)))).alias("links"),
    )

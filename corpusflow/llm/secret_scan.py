"""Operator 9: secret scan.

Base patterns (leftmost, non-overlapping per kind) find assignments, access keys and
long hexadecimal strings.  The method adds strings that no pattern names:

Dictionary-primed zstandard novelty.  Candidates are strings of one of the usual secret
alphabets near a sensitive word, in front of it or behind, or near a string that is reported
itself, so all lines of a key are tested.  Strings of less than 12 characters, without a digit or
of digits alone are words and numbers, not candidates.  What a candidate costs is measured in bytes: the
compressed size of its surroundings with it less that without it, both against a dictionary
of the identifiers and words that surround keys in code and settings.  Names, paths,
placeholders and repetitions of the surroundings cost little; a key can't be compressed.
A candidate that costs at least ``least_cost`` bytes a character is reported as ``novel``.  In a
long key, or among other keys, the coder adapts to the alphabet, so where the characters are spread
as evenly as random ones of an alphabet, nearly the entropy of that alphabet is enough.

Every row is judged alone: nothing is shuffled and memory is that of one text.  Spans are
in code points, end exclusive.  Null text is empty; repeated rows give the same result each; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import fields, map_rows, packed

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
SENSITIVE = re.compile(
    r"passphrase|passw|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|signing[_ -]?key|credential|bearer|authorization",
    re.IGNORECASE | re.ASCII,
)
LEAST = 12
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=~-]{{{LEAST},}}")
ASSIGN_HINTS = ("passw", "secret", "token", "api")
SENSITIVE_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "authorization")
REACH = 48
SHARE = 0.85  # next to other keys the coder knows the alphabet and the bytes are whole
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = [
    (len(a), frozenset(a))
    for a in (DIGITS + UPPER[:6], DIGITS + LOWER[:6], UPPER + DIGITS[2:8], LOWER + DIGITS[2:8], UPPER + DIGITS, LOWER + DIGITS, UPPER + LOWER + DIGITS)
]
AROUND = 160
#: Words and identifiers that surround keys in code, settings and prose.
WORDS = (
    "public static final String private const let var function return import from export default class def self this "
    "None null true false undefined config configuration settings environment production development staging localhost "
    "password passwd passphrase secret token api_key apiKey API_KEY access_key accessKey ACCESS_KEY_ID SECRET_ACCESS_KEY "
    "client_id client_secret clientSecret private_key publicKey signing_key credential credentials bearer authorization "
    "Authorization: Bearer Basic header headers cookie session sessionid username user email account database "
    "connection string host port https://www.example.com/path/index.html http://localhost:8080/api/v1/users "
    "YOUR_API_KEY_HERE your-token-here changeme change_me placeholder example_password test-token-value xxxxxxxxxxxxxxxx "
    "0000000000000000 1234567890 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ process.env os.environ getenv "
    "the and that with this for are was from have not you which their will "
)


def hinted(text: str, hints: tuple[str, ...]) -> bool:
    """Whether a pattern that needs one of the hints can match at all; much faster than the pattern."""
    low = text.lower()
    return any(h in low for h in hints)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds."""
    found = []
    if hinted(text, ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def candidates(text: str) -> Iterator[tuple[int, int, bool]]:
    """Strings of a secret's alphabet, and whether they lie within REACH characters of a sensitive word, on either side.

    Without a sensitive word there are none.  A string that a sensitive word opens starts behind it."""
    if not hinted(text, SENSITIVE_HINTS):
        return
    words = [m.span() for m in SENSITIVE.finditer(text)]
    if not words:
        return
    starts = [s for s, _ in words]
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        k = bisect_left(starts, start)
        start = max(start, words[k - 1][1] if k else 0)  # a word with a blank may reach into the string
        while k < len(words) and starts[k] < min(end, start + LEAST):
            start = words[k][1]
            k = bisect_left(starts, start, k)
        if end - start < LEAST:
            continue
        s = text[start:end]
        kinds = any(c.isdigit() for c in s) + any(c.islower() for c in s) + any(c.isupper() for c in s)
        if kinds >= 2 and any(c.isdigit() for c in s):
            after = bisect_left(starts, end)
            yield start, end, (k > 0 and start - words[k - 1][1] <= REACH) or k < after or (after < len(words) and starts[after] - end <= REACH)


def uniform_alphabet(s: str) -> int:
    """Size of the usual alphabet that ``s`` is drawn from as if at random, else 0: its characters meet each other about
    as rarely as they would then (three deviations more and a fifth), unlike letters of words."""
    n = len(s)
    if n < 24:
        return 0
    size = next((k for k, of in ALPHABETS if of.issuperset(s)), 66)
    met = sum(c * (c - 1) for c in Counter(s).values()) * size / (n * (n - 1))
    return size if met <= 1.2 + 3 * math.sqrt(2 * size) / n else 0


class Novelty:
    def __init__(self, words: str = WORDS, level: int = 9):
        import zstandard

        primed = zstandard.ZstdCompressionDict(words.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compress = zstandard.ZstdCompressor(level=level, dict_data=primed, write_checksum=False, write_content_size=False).compress

    def cost(self, text: str, start: int, end: int) -> float:
        """Marginal compressed bytes for each character of text[start:end]."""
        before, after = text[max(0, start - AROUND) : start].encode(), text[end : end + AROUND].encode()
        whole = len(self.compress(before + after + text[start:end].encode()))
        return (whole - len(self.compress(before + after))) / (end - start)

    def novel(self, text: str, start: int, end: int, least_cost: float) -> bool:
        size = uniform_alphabet(text[start:end])
        return self.cost(text, start, end) >= (min(least_cost, SHARE * math.log2(size) / 8) if size else least_cost)


class Spans:
    """Which stretches of a text the given (start, kind, end) cover."""

    def __init__(self, found: list[tuple[int, int, int]]):
        self.starts, self.ends = [], []
        for start, _, end in sorted(found):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meet(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end) - 1
        return i >= 0 and self.ends[i] > start


def scan(text: str, novelty: Novelty, least_cost: float) -> list[tuple[int, int, int]]:
    found = base_spans(text)
    base = Spans(found)
    strings = list(candidates(text))
    judged: dict[int, bool] = {}

    def secret(i: int) -> bool:
        start, end, _ = strings[i]
        if i not in judged:
            judged[i] = base.meet(start, end) or novelty.novel(text, start, end, least_cost)
        return judged[i]

    taken: set[int] = set()
    for order, side in ((range(len(strings)), -1), (range(len(strings) - 1, -1, -1), 1)):
        for i in order:
            beside = i + side
            gap = (strings[i][0] - strings[beside][1] if side < 0 else strings[beside][0] - strings[i][1]) if beside in taken else REACH + 1
            if (strings[i][2] or gap <= REACH) and secret(i):
                taken.add(i)
    for i in taken:
        start, end, _ = strings[i]
        if not base.meet(start, end):
            found.append((start, 3, end))
    return sorted(found)


def spell(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"


def scan_secrets(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, least_cost: float = 0.8) -> DataFrame:
    """``keep`` columns, counts by kind, digest of the base spans and all spans of every row."""
    schema = fields(SCHEMA)

    def start():
        novelty = Novelty()

        def kernel(texts):
            rows = []
            for text in texts:
                found = scan(text or "", novelty, least_cost)
                base = spell([x for x in found if x[1] < 3])
                n = [sum(x[1] == k for x in found) for k in range(4)]
                rows.append((*n[:3], hashlib.sha256(base.encode()).hexdigest(), spell(found), n[3]))
            return dict(zip(schema.names, zip(*rows))) if rows else {k: [] for k in schema.names}

        return kernel

    return map_rows(df, start, schema, [text_col], keep if keep is not None else ["doc_id"])


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with a mark in place of each group of overlapping spans."""
    out, at = [], 0
    for start, kind, end in found:
        if start >= at:
            out += [text[at:start], f"[SECRET:{KINDS[kind]}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact_secrets(df: DataFrame, text_col: str = "text", least_cost: float = 0.8) -> DataFrame:
    """``df`` with secrets replaced in the text; rows without secrets are unchanged, null stays null."""
    schema = fields("_clean string")

    def start():
        novelty = Novelty()

        def kernel(texts):
            return {"_clean": [None if t is None else redact(t, scan(t, novelty, least_cost)) for t in texts]}

        return kernel

    from pyspark.sql import functions as F

    made = map_rows(packed(df), start, schema, [("_row", text_col)], ["_row"])
    return made.select(*[F.col("_clean").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in df.columns])

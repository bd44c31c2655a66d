"""Personal data: regular expressions propose spans, validators confirm them, context words adjust the score.

Kinds: EMAIL, PHONE, CARD (Luhn), IBAN (country length and mod-97), IPV4 (octets), SSN (number ranges), SECRET (assigned to a key word,
or with a known prefix; Shannon entropy). A proposal that its validator rejects is dropped. The score is the kind's base, plus
UP where a supporting word stands within NEAR characters before or AFTER behind, minus DOWN where a contrary one does; spans of at
least THRESHOLD stay. For cards every stretch of a run of digits that begins and ends with a group is tried, as dates, codes and numbers may stand beside one. Of overlapping spans the one with the highest score stays, then the longest, then the first.

A SECRET is a run of at least SHORTEST characters that holds a digit, or a capital after a small letter; one with a known prefix needs neither. A run of small letters
alone, however long, is taken for a word.

Every kind but SECRET needs a digit or an @, and a SECRET without a digit one of KEYS, so a text with none of them is passed over by cheap searches; all other texts are
searched whole. No kind has a longest length but those that its own rules set (63 characters for a label of a host name).

Defined results: null and empty texts have no spans and are redacted to themselves; a null doc_id stays null in the rows of its spans; repeated rows give
their spans each; an empty table gives an empty result; other columns are passed through untouched.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import _shared as S

THRESHOLD, UP, DOWN, NEAR, AFTER = 0.5, 0.25, 0.3, 48, 16

ANY = re.compile(r"[0-9@]")
KEYS = ("token", "secret", "key", "passw", "bearer", "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-")
SHORTEST = 16
AT = re.compile(r"@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,63}(?![A-Za-z0-9])")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+\-]")
HIDDEN = re.compile(r"[0-9]|[a-z][A-Z]")
PHONE = re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}(?![\w-])|(?<![\w.])\+\d{8,15}(?!\w)")
DIGITS = re.compile(r"(?<![\w.])\d(?:[ -]?\d){12,}(?!\w)")
GROUP = re.compile(r"\d+")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
IPV4 = re.compile(r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
SECRET = re.compile(
    r"""(?:token|secret|api[_ -]?key|access[_ -]?key|passw(?:or)?d|bearer)["']?\s{0,3}[:=]?\s{0,3}["']?([A-Za-z0-9+/_\-]{16,})|(?<![A-Za-z0-9])((?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9])""",
    re.I,
)

BASE = {"EMAIL": 0.9, "PHONE": 0.35, "CARD": 0.6, "IBAN": 0.8, "IPV4": 0.6, "SSN": 0.55, "SECRET": 0.8}
FOR = {
    "EMAIL": "mail email e-mail contact write",
    "PHONE": "phone tel telephone call mobile cell fax whatsapp sms",
    "CARD": "card visa mastercard amex credit debit payment carte tarjeta karte",
    "IBAN": "iban account bank konto compte cuenta transfer",
    "IPV4": "ip address host server addr login",
    "SSN": "ssn social security taxpayer",
    "SECRET": "token secret key password api auth",
}
AGAINST = {
    "PHONE": "version isbn issn order invoice page pages",
    "CARD": "order invoice tracking isbn serial",
    "IPV4": "version release build section chapter v",
    "SSN": "order part serial isbn",
    "SECRET": "sha sha1 sha256 md5 commit checksum example",
}
_FOR = {k: frozenset(v.split()) for k, v in FOR.items()}
_AGAINST = {k: frozenset(v.split()) for k, v in AGAINST.items()}
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20,
    "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30,
    "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28,
    "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SV": 28, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def _context(kind: str, text: str, start: int, end: int) -> float:
    near = {w.lower() for w in _WORD.findall(text[max(0, start - NEAR) : start])} | {w.lower() for w in _WORD.findall(text[end : end + AFTER])}
    return UP * bool(near & _FOR[kind]) - DOWN * bool(near & _AGAINST.get(kind, frozenset()))


def _ascii_digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def cards(run: str) -> Iterator[tuple[int, int]]:
    """Stretches of 13 to 19 digits of a run, from the begin of a group of digits to the end of one, that pass Luhn."""
    digits = _ascii_digits(run)
    sums = [[0], [0]]  # of the digits so far, with those at even or at odd places doubled
    for k, c in enumerate(digits):
        twice = 2 * int(c) - 9 * (c > "4")
        sums[k % 2].append(sums[k % 2][-1] + twice)
        sums[1 - k % 2].append(sums[1 - k % 2][-1] + int(c))
    ends, n = [], 0
    for g in GROUP.finditer(run):
        first, n = n, n + len(_ascii_digits(g.group()))
        ends.append((g.start(), g.end(), first, n))
    for k, (start, _, first, _) in enumerate(ends):
        for _, end, _, last in ends[k : k + 19]:
            if last - first > 19:
                break
            if last - first >= 13 and (sums[last % 2][last] - sums[last % 2][first]) % 10 == 0 and len(set(digits[first:last])) > 1:
                yield start, end


def proposals(text: str) -> Iterator[tuple[int, int, str, float]]:
    """(start, end, kind, base score) of the spans that their validators confirm."""
    if "@" in text:
        before = 0  # no local part holds an @, so each is looked for behind the last one
        for m in AT.finditer(text):
            before = max(before, text.rfind("@", 0, m.start()) + 1)
            turned = text[before : m.start()][::-1]
            name = turned[: bad.start() if (bad := NOT_LOCAL.search(turned)) else None][::-1].lstrip(".")
            if name and ".." not in name and not name.endswith("."):
                yield m.start() - len(name), m.end(), "EMAIL", BASE["EMAIL"]
            before = m.end()
    for m in DIGITS.finditer(text):
        for start, end in cards(m.group()):
            yield m.start() + start, m.start() + end, "CARD", BASE["CARD"]
    for m in PHONE.finditer(text):
        v, n = m.group(), len(_ascii_digits(m.group()))
        if 7 <= n <= 15:
            yield m.start(), m.end(), "PHONE", BASE["PHONE"] + 0.25 * (v[0] == "+") + 0.2 * ("(" in v)
    for m in IPV4.finditer(text):
        parts = m.group().split(".")
        if all(int(p) <= 255 and (p == "0" or p[0] != "0") for p in parts):
            yield m.start(), m.end(), "IPV4", BASE["IPV4"]
    for m in SSN.finditer(text):
        a, b, c = m.group().split("-")
        if a not in ("000", "666") and a[0] != "9" and b != "00" and c != "0000":
            yield m.start(), m.end(), "SSN", BASE["SSN"]
    for m in IBAN.finditer(text):
        whole = m.group()
        want = IBAN_LENGTH.get(whole[:2])
        solid = whole.replace(" ", "")
        if want and len(solid) >= want and solid.isascii() and mod97(solid[:want]):
            end, seen = 0, 0
            while seen < want:
                seen += whole[end] != " "
                end += 1
            yield m.start(), m.start() + end, "IBAN", BASE["IBAN"]
    for m in SECRET.finditer(text):
        g = 1 if m.group(1) else 2
        v = m.group(g)
        if (g == 2 or HIDDEN.search(v)) and entropy(v) >= 3.0:
            yield m.start(g), m.end(g), "SECRET", BASE["SECRET"]


def spans(text: str | None) -> list[tuple[int, int, str, float]]:
    """The spans that stay, by start."""
    if not text or not ANY.search(text) and not any(k in low for low in [text.lower()] for k in KEYS):
        return []
    scored = []
    for start, end, kind, base in proposals(text):
        score = round(min(1.0, max(0.0, base + _context(kind, text, start, end))), 4)
        if score >= THRESHOLD:
            scored.append((start, end, kind, score))
    if len(scored) < 2:
        return scored
    # spans that overlap in a chain are settled among themselves, so a text with many spans stays cheap
    scored.sort(key=lambda s: (s[0], s[1]))
    out, chain, reach = [], [], -1
    for s in [*scored, (math.inf, math.inf, "", 0.0)]:
        if chain and s[0] >= reach:
            kept: list[tuple[int, int, str, float]] = []
            for c in sorted(chain, key=lambda c: (-c[3], c[0] - c[1], c[0], c[2])):
                at = bisect_left(kept, c)  # those that stay don't overlap, so only its neighbours can be in the way
                if (at == 0 or kept[at - 1][1] <= c[0]) and (at == len(kept) or c[1] <= kept[at][0]):
                    kept.insert(at, c)
            out += kept
            chain = []
        chain.append(s)
        reach = s[1] if len(chain) == 1 else max(reach, s[1])
    return out


def redacted(text: str | None) -> str | None:
    found = spans(text)
    if not found:
        return text
    parts, at = [], 0
    for start, end, kind, _ in found:
        parts += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*parts, text[at:]])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in S.slices(batches, "text", 8_000_000):
        rows = []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for start, end, kind, score in spans(t):
                v = t[start:end]
                rows.append((i, kind, start, end, v[:2] + "*" * (len(v) - 2), score))
        if rows:
            i, kind, start, end, masked, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int64()), pa.array(kind), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(masked), pa.array(score, pa.float64())],
                names=["doc_id", "kind", "start", "end", "masked", "score"],
            )


def find_pii(docs: DataFrame) -> DataFrame:
    """One row for each span: doc_id, kind, start, end (characters), masked value, score."""
    S.ship(docs.sparkSession)
    skinny = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    return skinny.mapInArrow(_find, "doc_id long, kind string, start int, end int, masked string, score double")


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in S.slices(batches, "text", 8_000_000):
        at = b.schema.get_field_index("text")
        new = [redacted(t) for t in b.column(at).to_pylist()]
        cols = list(b.columns)
        cols[at] = pa.array(new, b.schema.field(at).type)
        n = b.schema.get_field_index("n_chars")
        if n >= 0 and pa.types.is_integer(b.schema.field(n).type):
            cols[n] = pa.array([None if t is None else len(t) for t in new], b.schema.field(n).type)
        yield pa.RecordBatch.from_arrays(cols, schema=b.schema)


def redact_pii(docs: DataFrame) -> DataFrame:
    """docs with each span replaced by [KIND]; an integer n_chars becomes the new length."""
    S.ship(docs.sparkSession)
    return docs.mapInArrow(_redact, docs.schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(S.table(spark, sf_dir, "documents"))

"""Personal data: a semi-Markov conditional random field beside fixed patterns.

Around every digit, ``@``, spelled-out ``at``/``dot`` or printed IBAN the text is cut into tokens. Every run of tokens that
may be an entity (of ``SHORT`` tokens, or as long as its kind can be) is scored as a whole (shape, length, check digits,
separators, cue words before it), and dynamic programming chooses the best cover of the tokens by entities and single
other tokens, so that boundaries and types are decided together. Elsewhere in the text no entity is possible, so this
equals a pass over all tokens. The field is trained by maximum likelihood on sentences made from a seeded generator.

The fixed patterns' matches always stay; the field's segments are added where they overlap none of these.

Nulls are empty texts and hold nothing. Spans are code points, end exclusive, sorted by kind, then start. Repeated rows
are searched one by one; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, table

#: In the order in which spans are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "secret", "ssn")
#: Tokens of the runs that are tried whatever they hold, and characters of the longest entity.
SHORT, LONGEST = 14, 320
#: Training: sentences, passes, step, penalty.
SENTENCES, PASSES, STEP, PENALTY = 240, 4, 0.5, 1e-4

# Possessive forms of the patterns: what they skip can't begin a match.
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _octet(digits: str) -> bool:
    """Whether a number of any length is at most 255."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping e-mail addresses, found from each ``@`` outwards."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > free and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _HOST.match(text, at) if lo < at else None
        if m:
            out.append((lo, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' matches that pass their checks, by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(_octet(x) for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


# --- the field ---------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[A-Za-z0-9]+|[^\W]+|\S|\s+")
_WORD, _TRIGGER = re.compile(r"\S+"), re.compile(r"[0-9@]")
_SPELLED = ("(at)", "[at]", "( at )", " dot ")
_MAIL = re.compile(r"[A-Za-z0-9._%+-]+\s?(?:@|[\[(]\s?at\s?[\])]|\sat\s)\s?[A-Za-z0-9-]+(?:\s?(?:\.|[\[(]\s?dot\s?[\])]|\sdot\s)\s?[A-Za-z0-9-]+)+")
_AT = re.compile(r"\s?[\[(]\s?at\s?[\])]\s?|\sat\s")
_BRACKETED_AT = re.compile(r"[\[(]\s?at\s?[\])]")
_SPELLED_DOT = re.compile(r"\sdot\s")
# As far as each kind goes from its start: 34 characters of an IBAN in groups and 19 digits of a number.
_IBAN_RUN = re.compile(r"[A-Z]{2}\d\d[ A-Z0-9]{0,38}")
_IBAN_PRINTED = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2} ?(?:[A-Z0-9]{4} ?){2,7}[A-Z0-9]{1,4}(?![A-Za-z0-9])")
_NUMBER_RUN = re.compile(r"(?:[ ().+/-]{0,3}[0-9]){1,19}")
_CUES = {
    "email": re.compile(r"(?i)\b(e-?mail|mail|contact|reach)\W*(\w+\W+)?$"),
    "ip": re.compile(r"(?i)\b(ip|host|server|address|from)\W*(\w+\W+)?$"),
    "card": re.compile(r"(?i)\b(card|visa|mastercard|credit|pan)\W*(\w+\W+)?$"),
    "phone": re.compile(r"(?i)\b(tel|phone|call|mobile|fax|telefon|cell)\W*(\w+\W+)?$"),
    "iban": re.compile(r"(?i)\b(iban|account|konto)\W*(\w+\W+)?$"),
    "secret": re.compile(r"(?i)\b(token|key|secret|password|passwd|api|bearer)\W*$"),
    "ssn": re.compile(r"(?i)\b(ssn|social security|security)\W*(\w+\W+)?$"),
}


def tokens(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, lo, hi)]


def spelled(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with a spelled-out at, from each outwards; without brackets, only those with a spelled-out dot."""
    for m in _AT.finditer(text):
        lo = m.start()
        while lo > 0 and m.start() - lo < LONGEST and text[lo - 1] in _LOCAL:
            lo -= 1
        found = _MAIL.match(text, lo) if lo < m.start() else None
        if found and (_BRACKETED_AT.search(m[0]) or _SPELLED_DOT.search(found[0])):
            yield found.span()


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches outside which no entity is possible; neighbours within two characters are one."""
    lo = hi = -1
    triggers = (m.span() for m in _WORD.finditer(text) if _TRIGGER.search(text, *m.span()))
    for start, end in sorted([*triggers, *(m.span() for m in _IBAN_PRINTED.finditer(text)), *spelled(text)]):
        if lo >= 0 and start - hi <= 2:
            hi = max(hi, end)
        else:
            if lo >= 0:
                yield lo, hi
            lo, hi = start, end
    if lo >= 0:
        yield lo, hi


@functools.lru_cache(1 << 14)
def _shape(s: str) -> tuple[tuple[str, str], ...]:
    """(kind, feature) pairs of one whole span, its surroundings aside."""
    digits = "".join(_DIGIT.findall(s))
    n, out = len(digits), []
    add = lambda kind, *names: out.extend((kind, x) for x in names)
    spaces = s.count(" ")
    if ("@" in s or " at " in s or "at" in s and ("(" in s or "[" in s)) and len(s) <= LONGEST:
        add("email", "form" if _MAIL.fullmatch(s) else "other", f"spaces{min(spaces, 5)}")
    if n and not re.search(r"[^0-9.]", s) and s.count(".") == 3:
        add("ip", "valid" if re.fullmatch(r"\d+(\.\d+){3}", s) and all(_octet(x) for x in s.split(".")) else "other")
    if n >= 12 and not re.search(r"[^0-9 -]", s):
        add("card", "luhn" if luhn(digits) else "noluhn", "size" if 13 <= n <= 19 else "nosize", "groups" if re.fullmatch(r"\d+|\d{4}([ -]\d{4}){2,3}([ -]\d{1,4})?", s) else "nogroups")
    if 7 <= n <= 15 and not re.search(r"[^0-9 ().+/-]", s):
        add("phone", "plus" if s[0] == "+" else "noplus", "parens" if re.search(r"\(\d+\)", s) else "noparens", f"digits{'7-9' if n < 10 else '10-13' if n < 14 else '14-15'}", "groups" if 2 <= len(re.findall(r"\d+", s)) <= 5 else "nogroups", "dots" if "." in s else "nodots", "date" if re.fullmatch(r"(\d{4}[-/. ]\d\d?[-/. ]\d\d?|\d\d?[-/. ]\d\d?[-/. ]\d{4})", s) else "nodate", "mixed" if "." in s and ("-" in s or "(" in s) else "even")
    if 15 <= len(s) <= 42 and re.match(r"[A-Z]{2}\d\d[ A-Z0-9]+$", s):
        flat = s.replace(" ", "")
        add("iban", "mod97" if int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1 else "nomod")
    if len(s) >= 16 and n >= 3 and not re.search(r"[^A-Za-z0-9_/+=-]", s):
        letters = len(set(s))
        add("secret", "hex" if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s) and n < len(s) else "nohex", "long" if len(s) >= 28 else "short", "varied" if letters >= 10 else "plain", "digitsonly" if n == len(s) else "letters")
    if n == 9 and re.fullmatch(r"\d{3}[- ]\d{2}[- ]\d{4}", s):
        add("ssn", "form")
    return tuple(out)


def segments(text: str, toks: list[tuple[int, int]]) -> list[list[tuple[int, str, list[str]]]]:
    """For each end (token count) the candidate segments (first token, kind, features)."""
    out: list[list[tuple[int, str, list[str]]]] = [[] for _ in range(len(toks) + 1)]
    stop = toks[-1][1] if toks else 0
    for i, (lo, _) in enumerate(toks):
        if not (text[lo].isalnum() or text[lo] in "+(") or text[lo] == "(" and lo and text[lo - 1].isalnum():
            continue
        before = text[max(0, lo - 40) : lo]
        left = "bare" if not before or before[-1].isspace() or before[-1] in "\"'(<:=|[" else "joined"
        mail = _MAIL.match(text, lo, min(stop, lo + LONGEST))
        whole = reach = mail.end() if mail else lo
        if len(toks) - i > SHORT:
            reach = max(reach, *(m.end() for run in (_IBAN_RUN, _NUMBER_RUN) if (m := run.match(text, lo, stop))), lo)
        for j in range(i + 1, len(toks) + 1):
            hi = toks[j - 1][1]
            if hi - lo > LONGEST or j - i > SHORT and hi > reach:
                break
            if not text[hi - 1].isalnum():
                continue
            right = "bare" if hi == len(text) or not (text[hi].isalnum() or text[hi] in "-_@/" and hi + 1 < len(text) and text[hi + 1].isalnum() or text[hi] == "." and hi + 1 < len(text) and text[hi + 1].isalnum()) else "joined"
            found: dict[str, list[str]] = {}
            for kind, feature in _shape(text[lo:hi]):
                found.setdefault(kind, []).append(feature)
            for kind, features in found.items():
                cue = "cue" if _CUES[kind].search(before) else "nocue"
                if kind == "email" and "form" not in features:
                    continue
                if kind == "email":
                    features = [*features, "whole" if hi == whole else "cut"]
                out[j].append((i, kind, [f"{kind}:{x}" for x in (*features, "bias", f"left-{left}", f"right-{right}", cue)]))
    return out


def _score(weights: dict[str, float], features: list[str]) -> float:
    return sum(weights.get(x, 0.0) for x in features)


def decode(text: str, toks: list[tuple[int, int]], weights: dict[str, float]) -> list[tuple[str, int, int]]:
    """The best segmentation's entities. Ties: the segment that starts later, then the kind that sorts first."""
    ends = segments(text, toks)
    if not any(ends):
        return []
    best, back = [0.0] * (len(toks) + 1), [None] * (len(toks) + 1)
    for j in range(1, len(toks) + 1):
        best[j] = best[j - 1]
        for i, kind, features in sorted(ends[j], key=lambda x: (-x[0], x[1])):
            s = best[i] + _score(weights, features)
            if s > best[j]:
                best[j], back[j] = s, (i, kind)
    out, j = [], len(toks)
    while j:
        if back[j]:
            i, kind = back[j]
            out.append((kind, toks[i][0], toks[j - 1][1]))
            j = i
        else:
            j -= 1
    return out[::-1]


def _add_logs(a: float, b: float) -> float:
    hi, lo = max(a, b), min(a, b)
    return hi + math.log1p(math.exp(lo - hi)) if lo > -1e300 else hi


def gradient(text: str, gold: set[tuple[str, int, int]], weights: dict[str, float]) -> dict[str, float]:
    """Observed minus expected features of one sentence, by forward and backward sums over all segmentations."""
    toks = tokens(text, 0, len(text))
    ends = segments(text, toks)
    n = len(toks)
    scored = [[(i, k, f, _score(weights, f)) for i, k, f in x] for x in ends]
    alpha = [0.0] + [-1e301] * n
    for j in range(1, n + 1):
        alpha[j] = alpha[j - 1]
        for i, _, _, s in scored[j]:
            alpha[j] = _add_logs(alpha[j], alpha[i] + s)
    beta = [-1e301] * n + [0.0]
    starts: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for j, x in enumerate(scored):
        for i, _, _, s in x:
            starts[i].append((j, s))
    for i in range(n - 1, -1, -1):
        beta[i] = beta[i + 1]
        for j, s in starts[i]:
            beta[i] = _add_logs(beta[i], s + beta[j])
    out: dict[str, float] = {}
    for j, x in enumerate(scored):
        for i, kind, features, s in x:
            d = ((kind, toks[i][0], toks[j - 1][1]) in gold) - math.exp(min(0.0, alpha[i] + s + beta[j] - alpha[n]))
            if abs(d) > 1e-6:
                for f in features:
                    out[f] = out.get(f, 0.0) + d
    return out


def example(rng: random.Random) -> tuple[str, set[tuple[str, int, int]]]:
    """One made sentence with its entities."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(["an", "the", "er", "on", "ti", "re", "sch", "qu", "o"]) for _ in range(rng.randint(1, 4)))

    def card() -> str:
        d = digits(15)
        d += next(str(x) for x in range(10) if luhn(d + str(x)))
        return rng.choice([d, d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4))])

    def iban() -> str:
        letters = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
        country, body = rng.choice([("DE", digits(18)), ("DE", digits(18)), ("GB", letters(4) + digits(14)), ("PL", digits(24)), ("MT", letters(4) + digits(5) + letters(4) + digits(9))])
        check = 98 - int("".join(str(int(c, 36)) for c in body + country) + "00") % 97
        s = f"{country}{check:02d}{body}"
        return rng.choice([s, " ".join(s[i : i + 4] for i in range(0, len(s), 4))])

    def hidden() -> str:
        at, dot = rng.choice([(" at ", " dot "), (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" (at) ", ".")])
        return rng.choice(["", f"{word()}."]) + word() + at + dot.join([*(word() for _ in range(rng.randint(1, 3))), rng.choice(["com", "org"])])

    host = lambda: f"{word()}.{rng.choice(['com', 'org', 'example.net'])}"
    made = {
        "email": lambda: rng.choice([f"{word()}.{digits(2)}@{host()}", f"{word()}@{host()}", f"{word()} (at) {word()}.com", f"{word()} [at] {word()} [dot] org", f"{word()} at {word()} dot com", hidden(), hidden()]),
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: rng.choice([f"+1 ({digits(3)}) 555-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+49 {digits(3)} {digits(7)}", f"0{digits(3)} {digits(7)}", f"0{digits(2)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}"]),
        "iban": iban,
        "secret": lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40, 64]))),
        "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
    }
    cues = {"email": ["mail", "contact"], "ip": ["host", "from"], "card": ["card", "visa"], "phone": ["call", "tel", "phone"], "iban": ["IBAN"], "secret": ['token = "', "key: "], "ssn": ["SSN"]}
    other = [lambda: str(rng.randint(1900, 2030)), lambda: f"{rng.randint(1, 31)}.{rng.randint(1, 12)}.{rng.randint(1990, 2030)}", lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"{digits(3)},{digits(3)}", lambda: digits(rng.randint(1, 6)), lambda: digits(rng.choice([10, 12, 13, 16, 20])), lambda: f"{digits(3)}.{digits(3)}", lambda: f"{digits(1)}.{digits(1)}", lambda: f"999.{digits(3)}.300.{digits(3)}", lambda: f"{word()}@{word()}", lambda: f"v{digits(1)}.{digits(1)}.{digits(1)}.{digits(1)}-{word()}", lambda: f"ISBN 978-{digits(1)}-{digits(3)}-{digits(5)}-{digits(1)}", lambda: f"{word()}{digits(3)}"]
    text, gold = "", set()
    for _ in range(rng.randint(2, 4)):
        text += " ".join(word() for _ in range(rng.randint(1, 4))) + " "
        if rng.random() < 0.55:
            kind = rng.choice(KINDS)
            if rng.random() < (0.7 if kind in ("secret", "phone") else 0.3):
                text += rng.choice(cues[kind])
                text += "" if text[-1] in ' "' else " "
            s = made[kind]()
            gold.add((kind, len(text), len(text) + len(s)))
            text += s + rng.choice([" ", ". ", ", ", "!! ", '" ', "%%% "])
        else:
            x = rng.choice(other)()
            text += x + rng.choice([" ", ". ", "### "])
    return text, gold


@functools.cache
def trained(seed: int = 7) -> dict[str, float]:
    """The field's weights: stochastic gradient steps (Adagrad) on the penalised log-likelihood."""
    rng = random.Random(seed)
    made = [example(rng) for _ in range(SENTENCES)]
    weights: dict[str, float] = {}
    squares: dict[str, float] = {}
    for _ in range(PASSES):
        for text, gold in made:
            for f, d in gradient(text, gold, weights).items():
                d -= PENALTY * weights.get(f, 0.0)
                squares[f] = squares.get(f, 0.0) + d * d
                weights[f] = weights.get(f, 0.0) + STEP * d / math.sqrt(squares[f] + 1e-8)
    return weights


def spans(text: str, weights: dict[str, float]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), sorted by kind as listed, then start."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    more = []
    if base or _DIGIT.search(text) or any(x in text for x in ("@", *_SPELLED)) or _BRACKETED_AT.search(text):
        for lo, hi in regions(text):
            for kind, a, b in decode(text, tokens(text, lo, hi), weights):
                if not any(a < y and x < b for x, y in taken):
                    more.append((kind, a, b))
    everything = sorted({*base, *more}, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
    return base, everything


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans (string), n_spans (of all kinds)."""
    weights = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        show = lambda x: ",".join(f"{k}:{a}:{b}" for k, a, b in x)
        for b in chunks(batches, "text"):
            got = [spans(t or "", weights) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array([sum(x[0] == k for x in base) for base, _ in got], pa.int64()) for k in BASE_KINDS], pa.array([hashlib.sha256(show(base).encode()).hexdigest() for base, _ in got]), pa.array([show(every) for _, every in got]), pa.array([len(every) for _, every in got], pa.int64())],
                ["doc_id", *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans", "n_spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint")


def masked(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each stretch of overlapping spans replaced by its first span's kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(found, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked in ``text``; nulls stay null. ``n_chars``, where present, follows the text."""
    weights = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            at = b.schema.get_field_index("text")
            texts = [t if t is None else masked(t, spans(t, weights)[1]) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, b.schema.field(at).type) if i == at else b.column(i) for i in range(b.num_columns)], schema=b.schema)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))

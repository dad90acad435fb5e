"""Personal data by anchors.

One Aho-Corasick automaton finds the cues of all kinds in a single pass over a
text: at-signs, a plus before a digit, a dot between digits, two digits that
are adjacent or one blank or hyphen apart, scheme separators, and words that
announce an identifier. Each cue starts a local parser, which walks left and
right over the characters that its kind allows and validates what it has found.
Parsers run left to right and never look at what an earlier match of their kind
has used up, so the spans are the leftmost non-overlapping ones. Where many
cues stand in one run of characters its end is found once, so the work grows
with the length of a text, whatever stands in it.

Kinds: email, ip, card and phone; and of the method's own url, account and secret.

An account is 6 to 34 letters and digits, of them four digits or more, with
hyphens between them (68 characters in all at most), or an IBAN whose check
digits hold, printed with blanks or without. A secret is a public service's key
by its beginning, a token of three parts of any length, a private key up to its
end line, however far (without one before the next key begins, its first line),
or 32 hex digits or more after a word that announces it.
"""

from __future__ import annotations

import hashlib
import string

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "secret")

_DIGITS = frozenset(string.digits)
_LABEL = frozenset(string.ascii_letters + string.digits + "-")
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_PHONE = frozenset(string.digits + " ().-")
_SCHEME = frozenset(string.ascii_letters + string.digits + "+.-")
_HEX = frozenset("0123456789abcdef")
_ALNUM = frozenset(string.ascii_letters + string.digits)
#: Words that announce an account, in lower case; they are also found capitalised and in capitals.
ACCOUNT_CUES = ("account", "acct", "iban", "passport", "ssn")
SECRET_CUES = ("api_key", "password", "secret", "token")
# How keys of public services begin, what they consist of, and how many characters follow at least and at most (None: no bound).
KEY_CUES = {"AKIA": ("upper", 16, 16), "ghp_": ("alnum", 36, 36), "xoxb-": ("label", 20, 80), "sk_live_": ("alnum", 24, 64), "eyJ": ("token", 40, None), "-----BEGIN ": ("pem", 0, 0)}
_KEY_CHARS = {"upper": frozenset(string.ascii_uppercase + string.digits), "alnum": frozenset(string.ascii_letters + string.digits), "label": frozenset(string.ascii_letters + string.digits + "-"), "token": frozenset(string.ascii_letters + string.digits + "-_.")}


def automaton() -> ahocorasick.Automaton:
    """Cues to (kind, length)."""
    cues: dict[str, set[str]] = {"@": {"email"}, "://": {"url"}}
    for a in string.digits:
        cues.setdefault(f"+{a}", set()).add("phone")
        for b in string.digits:
            cues.setdefault(f"{a}.{b}", set()).add("ip")
            for gap in ("", " ", "-"):
                cues.setdefault(f"{a}{gap}{b}", set()).add("card")
    for kind, words in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for w in words:
            for form in (w, w.capitalize(), w.upper()):
                cues.setdefault(form, set()).add(kind)
    for w in KEY_CUES:
        cues.setdefault(w, set()).add("secret")
    out = ahocorasick.Automaton()
    for cue, kinds in cues.items():
        out.add_word(cue, (tuple(sorted(kinds)), len(cue)))
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


# Each parser takes the text, the cue's start, the end of the last match of its
# kind and the text's Runs, and gives (start, end, valid) or None; what it spans
# is used up.


def _email(t: str, at: int, least: int, runs):
    a = at
    while a > least and t[a - 1] in _LOCAL:
        a -= 1
    if a == at:
        return None
    b, n, dots = at + 1, len(t), 0
    while b < n and t[b] in _LABEL:
        b += 1
    if b == at + 1:
        return None
    while b + 1 < n and t[b] == "." and t[b + 1] in _LABEL:
        dots += 1
        b += 2
        while b < n and t[b] in _LABEL:
            b += 1
    return (a, b, True) if dots else None


def _ip(t: str, at: int, least: int, runs):
    a = at
    while a > least and t[a - 1] in _DIGITS:
        a -= 1
    b, n, parts = a, len(t), []
    for i in range(4):
        if i:
            if b >= n or t[b] != ".":
                return None
            b += 1
        c = b
        while b < n and t[b] in _DIGITS:
            b += 1
        if b == c:
            return None
        parts.append(t[c:b].lstrip("0"))
    return a, b, all(len(p) < 3 or len(p) == 3 and p <= "255" for p in parts)


def _card(t: str, at: int, least: int, runs):
    b, n, digits = at + 1, len(t), [t[at]]
    while True:
        if b < n and t[b] in _DIGITS:
            digits.append(t[b])
            b += 1
        elif b + 1 < n and t[b] in " -" and t[b + 1] in _DIGITS:
            digits.append(t[b + 1])
            b += 2
        else:
            break
    return at, b, 16 <= len(digits) <= 19 and luhn("".join(digits))


def _phone(t: str, at: int, least: int, runs):
    b, n, last, digits = at + 2, len(t), 0, 1
    seen = 1
    while b < n and t[b] in _PHONE:
        if t[b] in _DIGITS:
            seen += 1
            if b >= at + 3:
                last, digits = b, seen
        b += 1
    return (at, last + 1, 8 <= digits <= 15) if last else None


class Runs:
    """Ends of runs of characters in a text, each run walked once; questions come from left to right."""

    def __init__(self, t: str):
        self.t, self.known, self.places = t, {}, {}

    def find(self, what: str, at: int) -> int:
        """Where ``what`` stands next, from ``at`` on; -1 if nowhere."""
        a, b = self.places.get(what, (0, -2))
        if b == -2 or at < a or (b >= 0 and at > b):
            b = self.t.find(what, at)
            self.places[what] = at, b
        return b

    def end(self, name: str, inside, at: int) -> int:
        """The end of the run of characters for which inside() holds, from ``at`` on."""
        a, b = self.known.get(name, (0, 0))
        if a <= at < b:
            return b
        t, n, b = self.t, len(self.t), at
        while b < n and inside(t[b]):
            b += 1
        self.known[name] = at, b
        return b


def _in_url(c: str) -> bool:
    return c > " " and c not in "\"'<>`\x7f"


def _url(t: str, at: int, least: int, runs: Runs):
    a = at
    while a > least and t[a - 1] in _SCHEME:
        a -= 1
    while a < at and not t[a].isalpha():
        a += 1
    stop = runs.end("url", _in_url, at)
    b = runs.known.get("url_end", (0, 0))
    if b[0] != stop:
        x = stop
        while x > at + 3 and t[x - 1] in ".,;:!?)]}":
            x -= 1
        runs.known["url_end"] = b = stop, x
    b = max(b[1], at + 3)
    host = t.find("/", at + 3, b)
    host = b if host < 0 else host
    return (a, b, True) if a < at and (t.find(".", at + 3, host) >= 0 or t.startswith("localhost", at + 3)) else None


def _value(t: str, b: int, name: str, inside, runs: Runs) -> tuple[int, int]:
    """The run of allowed characters that follows separators and small words like "no"."""
    n, stop = len(t), b + 12
    while b < n and b < stop and t[b] in " \t:=#\"'.":
        b += 1
    for word in ("number", "no.", "no", "id"):
        if t[b : b + len(word)].lower() == word and t[b + len(word) : b + len(word) + 1] in (" ", ":", "="):
            b, stop = b + len(word), b + len(word) + 12
            while b < n and b < stop and t[b] in " \t:=#\"'":
                b += 1
            break
    return b, runs.end(name, inside, b)


#: Letters as the two digits that stand for them in an IBAN's check sum.
_IBAN_DIGITS = str.maketrans({c: str(int(c, 36)) for c in string.ascii_letters})


def _printed_iban(t: str, a: int) -> int | None:
    """The end of an IBAN from ``a`` on, where its country and check digits stand, whose groups may be one blank apart: the longest that is right.

    The check sum goes on from group to group, so each character is looked at once.
    """
    head, n, size, rest, best = t[a : a + 4].translate(_IBAN_DIGITS), len(t), 0, 0, None
    shift = 10 ** len(head)
    first = int(head)
    b = a
    while b < n and size <= 34:
        c, limit = b, min(n, b + 35)
        while c < limit and t[c] in _ALNUM:
            c += 1
        if c == b:
            break
        digits = t[b if size else b + 4 : c].translate(_IBAN_DIGITS)
        if digits:
            rest = (rest * 10 ** len(digits) + int(digits)) % 97
        size += c - b
        if 15 <= size <= 34 and (rest * shift + first) % 97 == 1:
            best = c
        if c >= n or t[c] != " ":
            break
        b = c + 1
    return best


def _account(t: str, at: int, least: int, runs: Runs):
    if at and t[at - 1] in _ALNUM:
        return None
    word = runs.end("letters", str.isalpha, at)
    a, b = _value(t, word, "label", _LABEL.__contains__, runs)
    if t[a : a + 2].isalpha() and t[a : a + 2].isascii() and t[a + 2 : a + 4].isdigit() and t[a + 2 : a + 4].isascii():  # an IBAN: its check digits
        end = _printed_iban(t, a)
        if end:
            return a, end, True
        if b - a >= 15:
            return None
    if b - a > 68:
        return None
    value = t[a:b].replace("-", "")
    return (a, b, True) if a > word and 6 <= len(value) <= 34 and sum(c in _DIGITS for c in value) >= 4 else None


def _key(t: str, at: int, cue: str, runs: Runs):
    kind, low, high = KEY_CUES[cue]
    if kind == "pem":
        end = t.find("-----", at + len(cue), at + len(cue) + 60)
        if end < 0 or not t[at + len(cue) : end].endswith("PRIVATE KEY"):
            return None
        close, other = runs.find("-----END ", end), runs.find("-----BEGIN ", end)
        stop = t.find("-----", close + 9, close + 80) if close >= 0 and not 0 <= other < close else -1
        return at, stop + 5 if stop >= 0 else end + 5, True
    if at and t[at - 1] in _ALNUM:
        return None
    b = runs.end(kind, _KEY_CHARS[kind].__contains__, at + len(cue))
    if kind == "token":  # three parts with dots between them
        dots, c = 0, at - 1
        while dots < 3 and (c := runs.end(f"part {dots}", lambda x: x != ".", c + 1)) < b:
            dots += 1
        return (at, b, True) if low <= b - at - len(cue) and dots == 2 else None
    return (at, b, True) if low <= b - at - len(cue) <= high and (b == len(t) or t[b] not in _ALNUM) else None


def _secret(t: str, at: int, least: int, runs: Runs):
    for cue in KEY_CUES:
        if t.startswith(cue, at):
            return _key(t, at, cue, runs)
    word = runs.end("name", lambda c: c.isalpha() or c == "_", at)
    a, b = _value(t, word, "hex", _HEX.__contains__, runs)
    return (a, b, True) if b - a >= 32 and (b == len(t) or t[b] not in _ALNUM) else None


PARSERS = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "url": _url, "account": _account, "secret": _secret}


def find_spans(text: str, cues: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in code points, ends exclusive."""
    out: dict[str, list[tuple[int, int]]] = {}
    used, runs = dict.fromkeys(KINDS, 0), Runs(text)
    for end, (kinds, length) in cues.iter(text):
        at = end - length + 1
        for kind in kinds:
            if at < used[kind]:
                continue
            found = PARSERS[kind](text, at, used[kind], runs)
            if found:
                a, b, valid = found
                used[kind] = b
                if valid:
                    out.setdefault(kind, []).append((a, b))
    return out


def pii_spans(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id and spans, an array of (kind, start, end) by kind as in KINDS, then start.

    Null and empty texts have none. Rows with the same doc_id are looked at one
    by one, repeated rows too. Other columns of docs are dropped.
    """

    def run(batches):
        cues = automaton()
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                found = find_spans(text, cues) if text else {}
                out.append([{"kind": k, "start": a, "end": b} for k in KINDS for a, b in found.get(k, ())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kinds)], ["doc_id", "spans"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def mask(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
            at = b
    return "".join([*out, text[at:]])


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans if k in BASE).encode()).hexdigest()

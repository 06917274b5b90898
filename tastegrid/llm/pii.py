"""Personal data by anchor expansion.

One Aho-Corasick pass over the whole text finds anchors: at-signs, plus signs, digits, schemes and cue words. At each anchor
a small deterministic parser expands to the boundaries of one kind and validates what it found:

* email, ip, card, phone: the base kinds, leftmost and non-overlapping within a kind; a failing match is dropped and the
  search goes on behind it;
* login: a URL that carries a user and a password; secret: an access key, a private-key block, a signed web token, what follows
  ``Bearer``, or the value given to a token, key or password, of any length from 8 on, the name in upper or lower case and alone
  or in a longer one (``AWS_SECRET_ACCESS_KEY``); account: an IBAN (mod 97) or a social security number; address: a house number
  with a street name.

Spans are (kind, start, end) in code points, end exclusive, ordered by start and then kind as in ``KINDS``.

Defined cases: a null text is empty and has no spans; repeated rows are searched each; an empty table gives no rows; other
columns are ignored by ``scan`` and pass through ``redact`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.common import column

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "secret", "account", "address")

DIGITS = frozenset("0123456789")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOCAL = DIGITS | _LETTERS | frozenset("._%+-")
_LABEL = DIGITS | _LETTERS | frozenset("-")
_CAPITALS = DIGITS | frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_PHONE = DIGITS | frozenset(" ().-")
# Cue words before a secret, before an account, and after a street's name.
SECRET_CUES = ("token", "password", "passwd", "api_key", "apikey", "secret", "access_key", "accesskey", "private_key",
               "privatekey")  # in any case; the others as written
ACCOUNT_CUES = ("IBAN", "iban", "SSN", "ssn")
STREET_CUES = (" Street", " Avenue", " Road", " Lane", " Boulevard", " Drive", " St.", " Ave.", " Rd.")
SCHEMES = ("http://", "https://", "ftp://", "ssh://")
BEARER, BLOCK, WEB_TOKEN = "bearer", "-----BEGIN ", "eyJ"
EXACT = {"key": ("AKIA",), "block": (BLOCK,), "web": (WEB_TOKEN,), "account": ACCOUNT_CUES, "street": STREET_CUES, "scheme": SCHEMES}
_NAME = DIGITS | _LETTERS | frozenset("_-")
_TOKEN = _NAME | frozenset(".~+/=")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}  # keeps lengths, unlike str.lower


def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for d in DIGITS:
        found.add_word(d, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for kind, words in {"secret": SECRET_CUES, "bearer": (BEARER,), **EXACT}.items():
        for word in words:
            found.add_word(word.translate(_LOWER), (kind, len(word)))
    found.make_automaton()
    return found


def _run(text: str, at: int, chars: frozenset) -> int:
    """End of the run of ``chars`` from ``at``."""
    end = len(text)
    while at < end and text[at] in chars:
        at += 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def email_at(text: str, at: int, free: int) -> tuple[int, int] | None:
    """The address around the at-sign ``at`` whose name starts at ``free`` or later."""
    start = at
    while start > free and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    dots = 0
    while end + 1 < len(text) and text[end] == "." and text[end + 1] in _LABEL:
        end = _run(text, end + 1, _LABEL)
        dots += 1
    return (start, end) if dots else None


def ip_at(text: str, at: int) -> tuple[int, bool] | None:
    """End of four dotted numbers from ``at`` and whether all are at most 255."""
    parts, end = [], at
    for i in range(4):
        if i:
            if end >= len(text) or text[end] != ".":
                return None
            end += 1
        start, end = end, _run(text, end, DIGITS)
        if start == end:
            return None
        parts.append(text[start:end].lstrip("0"))
    return end, all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)


def card_at(text: str, at: int) -> tuple[int, bool] | None:
    """End of two or more digits, parted by at most one blank or hyphen each, and whether they are a card's number."""
    end, size = at + 1, len(text)
    while end < size:
        if text[end] in DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < size and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    if end == at + 1:
        return None
    digits = text[at:end].replace(" ", "").replace("-", "")
    return end, 14 <= len(digits) <= 19 and luhn(digits)


def phone_at(text: str, at: int) -> tuple[int, bool] | None:
    """End of the number behind the plus sign ``at`` and whether it has 10 to 15 digits."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = _run(text, at + 2, _PHONE)
    while end > at + 2 and text[end - 1] not in DIGITS:
        end -= 1
    if end < at + 4:
        return None
    digits = sum(c in DIGITS for c in text[at:end])
    return end, 10 <= digits <= 15


def login_at(text: str, start: int, behind: int) -> int | None:
    """End of a URL from ``start`` whose authority, from ``behind`` on, holds user:password@host."""
    end, stops = behind, "\"'<>"
    while end < len(text) and not text[end].isspace() and text[end] not in stops and text[end] != "/":
        end += 1
    name, at, host = text[behind:end].rpartition("@")
    if not (at and host and ":" in name and not name.startswith(":")):
        return None
    while end < len(text) and not text[end].isspace() and text[end] not in stops:
        end += 1
    return end


class Secrets:
    """Values of ``cue = "value"`` or ``cue: value`` in one text: 8 characters or more, and with a digit, in quotes, or behind an
    equals sign and a name that is the cue alone.

    Cues come from left to right; a name and a run of value characters are read once, so that all of them take linear time.
    """

    def __init__(self, text: str):
        self.text = text
        self.name_end = self.tried = self.run_end = self.digit = -1
        self.no_block = len(text)

    def block(self, start: int) -> tuple[int, int] | None:
        """A private-key block from its first line to its last, or to the end of its characters if that is missing."""
        head = self.text.find("-----", start + len(BLOCK), start + 80)
        if head < 0 or not self.text[start:head].endswith("PRIVATE KEY"):
            return None
        end = -1 if start >= self.no_block else self.text.find("-----END ", head)
        if end < 0:
            self.no_block = min(self.no_block, start)
            return start, _run(self.text, head + 5, _TOKEN - {"-"} | {"\n", "\r"})
        last = self.text.find("-----", end + 9, end + 80)
        return start, last + 5 if last >= 0 else end + 9

    def at(self, start: int, behind: int) -> tuple[int, int] | None:
        text, at, size = self.text, behind, len(self.text)
        alone = text[at:at + 1] not in _NAME and (start == 0 or text[start - 1] not in _NAME)
        if at < size and text[at] in _NAME:
            if not (text[at] in "_-" or text[at] in _CAPITALS and "a" <= text[at - 1] <= "z"):
                return None
            if self.name_end < at:
                self.name_end = _run(text, at, _NAME)
            at = self.name_end
        if at == self.tried:
            return None
        self.tried = at
        while at < size and text[at] in " \"'":
            at += 1
        if at >= size or text[at] not in "=:":
            return None
        assigned = text[at] == "="
        at += 1
        while at < size and text[at] in " \"'":
            at += 1
        if self.run_end < at:
            end, self.digit = at, -1
            while end < size and not text[end].isspace() and text[end] not in "\"',;<>":
                if text[end] in DIGITS:
                    self.digit = end
                end += 1
            self.run_end = end
        end = self.run_end
        quoted = text[at - 1] in "\"'" and text[end:end + 1] == text[at - 1]
        return (at, end) if end - at >= 8 and (self.digit >= at or quoted or assigned and alone) else None


def bearer_at(text: str, behind: int) -> tuple[int, int] | None:
    """The token behind ``Bearer``: 16 characters or more with a digit among them."""
    at = behind
    while at < len(text) and at < behind + 3 and text[at] == " ":
        at += 1
    end = _run(text, at, _TOKEN) if at > behind else at
    return (at, end) if end - at >= 16 and any(c in DIGITS for c in text[at:end]) else None


def web_token_at(text: str, at: int) -> tuple[int, int] | None:
    """A signed web token: three parts of ten characters or more, parted by dots, with nothing of the kind before."""
    if at and (text[at - 1] in _NAME or text[at - 1] == "."):
        return None
    end = _run(text, at, _NAME | {"."})
    parts = text[at:end].split(".")
    return (at, at + len(".".join(parts[:3]))) if len(parts) >= 3 and all(len(p) >= 10 for p in parts[:3]) else None


def access_key_at(text: str, at: int) -> tuple[int, int] | None:
    """An access key: the four letters at ``at`` and 16 more capitals or digits, with nothing of the kind around."""
    end = _run(text, at, _CAPITALS)
    return (at, end) if end == at + 20 and text[at - 1:at] not in _CAPITALS else None


def account_at(text: str, behind: int) -> tuple[int, int] | None:
    """The number behind the cue: an IBAN by its check digits, or three, two and four digits."""
    at = behind
    while at < len(text) and text[at] in " :#=.":
        at += 1
    if text[at:at + 1] in DIGITS:
        number = text[at:at + 11]
        shape = [len(p) for p in number.split("-")] == [3, 2, 4] and all(c in DIGITS for c in number.replace("-", ""))
        return (at, at + 11) if shape and text[at + 11:at + 12] not in DIGITS else None
    end, plain = at, ""
    while end < len(text) and len(plain) < 34:
        c = text[end]
        if c in DIGITS or "A" <= c <= "Z":
            plain += c
        elif not (c == " " and text[end + 1:end + 2] and (text[end + 1] in DIGITS or "A" <= text[end + 1] <= "Z")):
            break
        end += 1
        if len(plain) >= 15 and plain[:2].isalpha() and plain[2:4].isdigit():
            value = int("".join(str(int(x, 36)) for x in plain[4:] + plain[:4]))
            follows = text[end:end + 1]
            if value % 97 == 1 and not (follows in DIGITS or "A" <= follows <= "Z"):
                return at, end
    return None


def address_at(text: str, start: int, end: int) -> tuple[int, int] | None:
    """A house number and one to three capitalised words before the street cue that spans start to end."""
    at, names = start, 0
    while names <= 3:
        word_end = at
        while at > 0 and not text[at - 1].isspace() and word_end - at < 40:
            at -= 1
        word = text[at:word_end]
        if names and word and len(word) <= 5 and all(c in DIGITS for c in word):
            return at, end
        if not word or not word[0].isupper() or at == 0 or text[at - 1] != " ":
            return None
        names += 1
        at -= 1
    return None


_KIND_OF = {"scheme": "login", "street": "address", "secret": "secret", "key": "secret", "bearer": "secret",
            "block": "secret", "web": "secret", "account": "account"}


def find(text: str, automaton) -> list[tuple[str, int, int]]:
    """All spans of one text."""
    spans = []
    free = dict.fromkeys(KINDS, 0)  # per kind, where the next match may start

    def checked(kind: str, at: int, got: tuple[int, bool] | None) -> None:
        if got:
            free[kind] = got[0]
            if got[1]:
                spans.append((kind, at, got[0]))

    ip_seen = 0
    secrets = Secrets(text)
    for last, (anchor, width) in automaton.iter(text.translate(_LOWER)):
        at = last - width + 1
        if anchor in EXACT and text[at:last + 1] not in EXACT[anchor]:
            continue
        if anchor == "digit":
            if at >= free["card"]:
                checked("card", at, card_at(text, at))
            if at >= free["ip"] and at >= ip_seen:
                got = ip_at(text, at)
                checked("ip", at, got)
                ip_seen = _run(text, at, DIGITS)  # later starts in this run of digits fail alike
        elif anchor == "at":
            got = email_at(text, at, free["email"])
            if got:
                spans.append(("email", *got))
                free["email"] = got[1]
        elif anchor == "plus":
            if at >= free["phone"]:
                checked("phone", at, phone_at(text, at))
        elif at >= free[_KIND_OF[anchor]]:
            kind = _KIND_OF[anchor]
            if anchor == "key":
                got = access_key_at(text, at)
            elif anchor == "bearer":
                got = bearer_at(text, last + 1)
            elif anchor == "block":
                got = secrets.block(at)
            elif anchor == "web":
                got = web_token_at(text, at)
            elif kind == "login":
                end = login_at(text, at, last + 1)
                got = (at, end) if end else None
            elif kind == "address":
                got = address_at(text, at, last + 1)
            else:
                got = secrets.at(at, last + 1) if kind == "secret" else account_at(text, last + 1)
            if got:
                spans.append((kind, *got))
                free[kind] = got[1]
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(spans, key=lambda s: (s[1], order[s[0]], s[2]))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    merged: list[list] = []
    for kind, start, end in spans:
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans) per row; ``spans`` is an array of (kind, start, end)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end"), s)) for s in find(x.as_py() or "", automaton)]
                     for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["key", "spans"])

    rows = df.select(column(key).alias("key"), column(text).cast("string").alias("text"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with personal data in ``text`` replaced by placeholders; a null text stays null."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        for batch in batches:
            clean = []
            for x in batch.column(at):
                whole = x.as_py()
                spans = find(whole, automaton) if whole else []
                clean.append(redacted(whole, spans) if spans else whole)
            columns = [*batch.columns]
            columns[at] = pa.array(clean, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # names with dots can't be passed on as they are
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def query(spark, folder: str) -> DataFrame:
    """Spans of personal data in all documents, counted and written as text."""
    found = scan(spark.read.parquet(f"{folder}/documents.parquet"))
    written = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[of(k) for k in BASE], F.sha2(written(base), 256).alias("base_sha256"),
                        written(F.col("spans")).alias("spans"))

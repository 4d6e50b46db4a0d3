"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over the text: at-signs, plus signs, digits, scheme marks and identifier cues. From
each anchor a small parser expands to the boundaries of an address, number or account and validates it. Spans are in code points, end
exclusive. The four base kinds follow their published patterns, leftmost and without overlap within a kind; an expansion that fails its
check is dropped and its text is not tried again.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_batches, whole_text

# Character classes, cues and account lengths.
DIGITS = frozenset("0123456789")
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
LABEL = frozenset(string.ascii_letters + string.digits + "-")
PHONE = frozenset(" ().0123456789-")
SECRET = frozenset(string.ascii_letters + string.digits + "_-+/=.~")
KINDS = ["email", "ip", "card", "phone", "login", "account", "address", "secret"]
SCHEME_MARK = "://"
CUES = {
    "iban": "account", "account": "account", "acct": "account", "konto": "account", "compte": "account", "cuenta": "account",
    "ssn": "account", "passport": "account", "wallet": "address", "mac": "address", "ipv6": "address",
    "token": "secret", "password": "secret", "passwd": "secret", "secret": "secret", "api_key": "secret", "api-key": "secret", "apikey": "secret",
    "secret_key": "secret", "private_key": "secret",
}
ACCOUNT_DIGITS = (8, 18)
SECRET_LENGTH = 12


def automaton() -> ahocorasick.Automaton:
    """Anchors and what they lead to; cues stand in lower case, upper case and with a capital."""
    found = ahocorasick.Automaton()
    for anchor, what in [("@", "email"), ("+", "phone"), *((d, "digit") for d in DIGITS), (SCHEME_MARK, "login")]:
        found.add_word(anchor, (what, len(anchor)))
    for cue, kind in CUES.items():
        for form in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def run_of(text: str, at: int, allowed: frozenset[str]) -> int:
    """End of the run of allowed characters from `at` on."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Expand an at-sign to its local part, not before `floor`, and to a domain of two labels or more."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = run_of(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    labels, n = 1, len(text)
    while end + 1 < n and text[end] == "." and text[end + 1] in LABEL:
        end, labels = run_of(text, end + 2, LABEL), labels + 1
    return (start, end) if labels > 1 else None


def address_at(text: str, at: int) -> tuple[int, bool] | None:
    """End of four dotted numbers from the digit at `at`, and whether each is at most 255; None if there are fewer."""
    end, small = run_of(text, at, DIGITS), True
    start, n = at, len(text)
    for part in range(4):
        if part:
            if not (end + 1 < n and text[end] == "." and text[end + 1] in DIGITS):
                return None
            start, end = end + 1, run_of(text, end + 2, DIGITS)
        number = text[start:end].lstrip("0") or "0"
        small = small and len(number) <= 3 and int(number) <= 255
    return end, small


def number_at(text: str, at: int) -> int:
    """End of the digits from `at` on, single blanks or hyphens between them allowed."""
    end, n = at + 1, len(text)
    while end < n:
        if text[end] in DIGITS:
            end += 1
        elif end + 1 < n and text[end] in " -" and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    return end


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[::-2]))) % 10 == 0


def phone_at(text: str, at: int) -> tuple[int, bool] | None:
    """End of the number after a plus sign, which is its last digit, and whether it has 9 to 15 digits."""
    if not (at + 1 < len(text) and text[at + 1] in DIGITS):
        return None
    end = run_of(text, at + 2, PHONE)
    while end > at + 2 and text[end - 1] not in DIGITS:
        end -= 1
    if end < at + 4:
        return None
    return end, 9 <= sum(c in DIGITS for c in text[at:end]) <= 15


def login_at(text: str, at: int) -> tuple[int, int] | None:
    """Expand a scheme mark to scheme://name:password@host; without a password it is an ordinary link."""
    start, n = at, len(text)
    while start > 0 and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "+.-"):
        start -= 1
    end = at + len(SCHEME_MARK)
    name = end
    while end < n and not text[end].isspace() and text[end] not in "/?#@\"'<>":
        end += 1
    if start == at or end >= n or text[end] != "@" or ":" not in text[name:end].strip(":"):
        return None
    host = run_of(text, end + 1, LABEL | {"."})
    return (start, host) if host > end + 1 else None


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def value_after(text: str, at: int, most: int = 16) -> int:
    """Start of the value that follows a cue, after `most` blanks and marks at most, the words no and number among them."""
    stop = at + most
    while at < stop and text[at : at + 1] and text[at] in " \t:=#.":
        at += 1
        for word in ("number", "no"):
            if text[at : at + len(word)].lower() == word and not text[at + len(word) : at + len(word) + 1].isalpha():
                at += len(word)
    return at


def account_at(text: str, at: int) -> tuple[int, int] | None:
    """The account after a cue: an international account number with right check digits, or 8 to 18 digits."""
    start = value_after(text, at)
    if text[start : start + 2].isascii() and text[start : start + 2].isalpha() and text[start + 2 : start + 4].isdigit():
        end, kept, n = start, "", len(text)
        while end < n and len(kept) < 34 and text[end].isascii() and (text[end].isdigit() or text[end].isupper() or (text[end] == " " and end + 1 < n and (text[end + 1].isdigit() or text[end + 1].isupper()))):
            kept, end = kept + text[end].strip(), end + 1
        for size in range(len(kept), 14, -1):  # the text may go on in capitals or numbers
            if mod97(kept[:size]):
                while len(text[start:end].replace(" ", "")) > size:
                    end -= 1
                return start, end - (text[end - 1] == " ")
        return None
    if start < len(text) and text[start] in DIGITS:
        end = number_at(text, start)
        if ACCOUNT_DIGITS[0] <= sum(c in DIGITS for c in text[start:end]) <= ACCOUNT_DIGITS[1]:
            return start, end
    return None


def hex_address_at(text: str, at: int) -> tuple[int, int] | None:
    """The address after a cue: six hex pairs, eight hex groups, or a wallet's 0x and 40 hex digits."""
    start = value_after(text, at)
    end = run_of(text, start, frozenset(string.hexdigits + ":-x"))
    value = text[start:end]
    groups = value.replace("-", ":").split(":")
    if (len(groups) == 6 and all(len(g) == 2 for g in groups)) or (len(groups) == 8 and all(1 <= len(g) <= 4 for g in groups)):
        return (start, end) if "x" not in value else None
    return (start, end) if len(value) == 42 and value.startswith("0x") and "x" not in value[2:] else None


def secret_at(text: str, at: int) -> tuple[int, int] | None:
    """The value after a cue and an equals sign or colon, quoted or not: 12 characters or more, digits and letters among them."""
    start, n, marks = at, len(text), 0
    while start < n and start < at + 8 and text[start] in " \t\"'`:=":
        marks += text[start] in ":="
        start += 1
    if not marks:
        return None
    end = run_of(text, start, SECRET)
    while end > start and text[end - 1] in ".=-":  # ends of sentences and padding
        end -= 1
    value = text[start:end]
    mixed = any(c in DIGITS for c in value) and any(c not in DIGITS and c.isalpha() for c in value)
    return (start, end) if len(value) >= SECRET_LENGTH and mixed else None


Span = tuple[str, int, int]


def find_spans(text: str, anchors: ahocorasick.Automaton) -> list[Span]:
    """All spans of a text, by start and then by kind."""
    spans: list[Span] = []
    free = dict.fromkeys(KINDS, 0)  # where the next span of a kind may start

    def add(kind: str, start: int, end: int) -> None:
        spans.append((kind, start, end))
        free[kind] = end

    for last, (what, length) in anchors.iter(text):
        at = last - length + 1
        if what == "digit":
            if at >= free["ip"]:
                end = run_of(text, at, DIGITS)
                found = address_at(text, at) if end < len(text) and text[end] == "." else None
                if found and found[1]:
                    add("ip", at, found[0])
                else:
                    free["ip"] = found[0] if found else end
            if at >= free["card"]:
                end = number_at(text, at)
                digits = "".join(c for c in text[at:end] if c in DIGITS) if end - at >= 12 else ""
                if 12 <= len(digits) <= 19 and luhn(digits):
                    add("card", at, end)
                free["card"] = end
        elif what == "email":
            if at >= free["email"] and (found := email_at(text, at, free["email"])):
                add("email", *found)
        elif what == "phone":
            if at >= free["phone"] and (found := phone_at(text, at)):
                free["phone"] = found[0]
                if found[1]:
                    add("phone", at, found[0])
        elif what == "login":
            if at >= free["login"] and (found := login_at(text, at)):
                add("login", *found)
        elif at == 0 or not text[at - 1].isalnum():
            if last + 1 < len(text) and not text[last + 1].isalpha() and at >= free[what]:
                found = {"account": account_at, "address": hex_address_at, "secret": secret_at}[what](text, last + 1)
                if found:
                    add(what, *found)
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


BASE = ("email", "ip", "card", "phone")


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = automaton()
    for batch in batches:
        found = [find_spans(t.as_py(), anchors) for t in batch.column("text")]
        rows = [[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in found]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end) of every row, by start and then by kind.

    Null and empty texts have no spans; a text of any length is scanned once, from end to end. Kinds may overlap one another, spans of one kind don't. Every row stands for itself, so repeated
    rows get equal answers and an empty table gives an empty result. Other columns are not read.
    """
    return map_batches(
        docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text")), _scan, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(documents(spark, sf_dir))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
        count("secret").alias("n_secret"), F.size("spans").cast("long").alias("n_spans"))

"""Operator 4: personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, schemes, digits, plus signs and cue words. A local
parser per kind then expands from the anchor and validates what it finds. An anchor is only tried where the
kind's last match has ended, so each kind gives its leftmost non-overlapping matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import documents

#: The kinds in the order of their reports; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "obfuscated", "login", "account")
_BASE = set(KINDS[:4])
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HIDDEN = re.compile(r"[\x20]?[A-Za-z0-9-]+(?:[\x20]?(?:\[dot\]|\(dot\)|\.)[\x20]?[A-Za-z0-9-]+)+")
_USERINFO = re.compile(r"[A-Za-z0-9._%~-]+:[^\s/@:]+@[A-Za-z0-9.-]+")
_ACCOUNT = re.compile(r"[\x20]*[:#=]?[\x20]*([A-Za-z]{2}[0-9]{2}(?:[\x20]?[A-Za-z0-9]){11,30}|[0-9]{3}-[0-9]{2}-[0-9]{4})(?![A-Za-z0-9])")
#: Words before an identifier of a person or account.
_CUES = ("iban", "ssn", "social security number")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _iban(text: str) -> bool:
    s = text.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, "digit")
    for word, kind in (("@", "at"), ("+", "plus"), ("://", "scheme"), ("[at]", "hidden"), ("(at)", "hidden")):
        a.add_word(word, kind)
    for cue in _CUES:
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            a.add_word(form, "cue")
    a.make_automaton()
    return a


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then by KINDS. Matches that fail a check are dropped and not retried."""
    out: list[tuple[int, int, str]] = []
    end = dict.fromkeys(KINDS, 0)
    no_ip = 0  # no address starts before

    def left(i: int, kind: str) -> int:
        k = i
        while k > end[kind] and text[k - 1] in _LOCAL:
            k -= 1
        return k

    def take(a: int, b: int, kind: str, good: bool) -> None:
        end[kind] = b
        if good:
            out.append((a, b, kind))

    for last, anchor in _automaton().iter(text):
        if anchor == "digit":
            if last >= end["card"] and (m := _CARD.match(text, last)):
                digits = m[0].replace(" ", "").replace("-", "")
                take(last, m.end(), "card", 12 <= len(digits) <= 19 and luhn(digits))
            if last >= end["ip"] and last >= no_ip:
                if m := _IP.match(text, last):
                    take(last, m.end(), "ip", all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")))
                else:
                    no_ip = _DIGITS.match(text, last).end()
        elif anchor == "at":
            if last >= end["email"] and (m := _DOMAIN.match(text, last + 1)) and (a := left(last, "email")) < last:
                take(a, m.end(), "email", True)
        elif anchor == "plus":
            if last >= end["phone"] and (m := _PHONE.match(text, last)):
                take(last, m.end(), "phone", 9 <= sum(c.isdigit() for c in m[0]) <= 15)
        elif anchor == "hidden":
            at = last - 3
            stop = at - 1 if at and text[at - 1] == " " else at
            if at >= end["obfuscated"] and (m := _HIDDEN.match(text, last + 1)) and (a := left(stop, "obfuscated")) < stop:
                take(a, m.end(), "obfuscated", True)
        elif anchor == "scheme":
            if last >= end["login"] and (m := _USERINFO.match(text, last + 1)):
                take(last + 1, m.end(), "login", True)
        elif last >= end["account"] and (m := _ACCOUNT.match(text, last + 1)):
            take(m.start(1), m.end(1), "account", m[1][3] == "-" or _iban(m[1]))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, or run of overlapping ones, replaced by its first kind in capitals and angle brackets."""
    parts, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            parts += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def personal_data(docs: DataFrame) -> DataFrame:
    """Adds pii, array of (start, end, kind), and redacted, the text with them replaced. Null or empty text: no spans, and the text as it is.

    Other columns stay; ones named pii or redacted are replaced. Whole texts are searched, however long, each row by itself; repeated rows get equal results, no rows give no rows.
    """
    keep = [c for c in docs.columns if c not in ("pii", "redacted")]
    place = keep.index("text")
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
    from pyspark.sql import types as T

    schema = docs.select(*keep).schema.add("pii", T.ArrayType(T.StructType().add("start", "integer").add("end", "integer").add("kind", "string"))).add("redacted", "string")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = part.column(place).to_pylist()
                found = [find(t) if t else [] for t in texts]
                clean = [redacted(t, s) if s else t for t, s in zip(texts, found, strict=True)]
                spans = pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in found], pa.list_(span))
                yield pa.RecordBatch.from_arrays([*part.columns, spans, pa.array(clean, pa.string())], [*keep, "pii", "redacted"])

    return docs.select(*keep).mapInArrow(rows, schema)


def _digest(spans) -> dict:
    base = F.filter(spans, lambda s: s["kind"].isin(*_BASE))
    text = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    counts = {f"n_{k}": number(k) for k in KINDS[:4]}
    return counts | {"base_sha256": F.sha2(text(base), 256), "spans": text(spans)}


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", *(c.alias(n) for n, c in _digest(F.col("pii")).items()))


def brute_force(text: str) -> str:
    """The base spans by plain regular expressions; for tests."""
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return joined(sorted(out, key=lambda s: (s[0], KINDS.index(s[2]))))

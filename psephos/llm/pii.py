"""Personal data by anchor expansion.

An Aho-Corasick automaton walks each text once and stops at anchors only: at-signs, plus signs, digits, scheme separators
and identifier cues. From an anchor, a local parser expands to the left and right, fixes the boundaries and validates what
it found (octet range, Luhn, digit count, mod-97). No parser looks further than the run of characters its own kind allows,
so the work is linear in the text. Offsets are code points, ends exclusive.

Defined cases: a null text is the empty text and has no spans; repeated rows give repeated results; a very long text is
walked whole; an empty table gives no rows; other columns of the input, whatever their names, are ignored by :func:`find_pii` and passed through by :func:`redact`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from psephos.llm.common import arrow_map, batch_of, place_of, small_batches, texts_of

#: In the order that breaks ties between spans of one start; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = 4

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
USERINFO = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=:-]+@[A-Za-z0-9.-]*[A-Za-z0-9](?::[0-9]+)?(?:[/?#][^\x00-\x20\"<>]*)?")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
ACCESS_KEY = re.compile(r"AKIA[A-Z2-7]{16}(?![A-Za-z0-9])")
LABELLED = re.compile(r"(?:\x20?(?:number|no|nr|id|num)\.?)?\x20?[:#=]\x20?([A-Z0-9][A-Z0-9-]{4,28}[A-Z0-9])(?![A-Za-z0-9])")
#: Cues that may stand before an account number; the number itself must follow a colon, hash or equals sign.
CUES = ("account", "acct", "iban", "passport", "ssn", "konto", "compte", "cuenta")


@lru_cache(maxsize=1)
def automaton():
    """Anchors and what they announce."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, (0, 1))
    a.add_word("@", (1, 1))
    a.add_word("+", (2, 1))
    a.add_word("://", (3, 3))
    a.add_word("AKIA", (4, 4))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            a.add_word(form, (5, len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _alone(text: str, at: int) -> bool:
    """No letter or digit stands right before ``at``."""
    return at == 0 or not text[at - 1].isalnum()


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all personal data in ``text``, by start and kind."""
    found: list[tuple[int, int, int]] = []
    email_from = ip_from = card_from = phone_from = url_from = account_from = 0
    for last, (anchor, length) in automaton().iter(text):
        at = last - length + 1
        if anchor == 0:
            if at >= ip_from:
                if m := IP.match(text, at):
                    ip_from = m.end()
                    if all(int(x[-9:]) <= 255 and (len(x) < 10 or not x[:-9].strip("0")) for x in m[0].split(".")):
                        found.append((at, 1, ip_from))
                else:
                    ip_from = DIGITS.match(text, at).end()
            if at >= card_from:
                if m := CARD.match(text, at):
                    card_from = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        found.append((at, 2, card_from))
                else:
                    card_from = at + 1
        elif anchor == 1:
            start = at
            while start > email_from and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                email_from = m.end()
                found.append((start, 0, email_from))
        elif anchor == 2:
            if at >= phone_from and (m := PHONE.match(text, at)):
                phone_from = m.end()
                if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                    found.append((at, 3, phone_from))
        elif anchor == 3:
            start = at
            while start > url_from and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "+.-"):
                start -= 1
            if start < at and text[start].isalpha() and (m := USERINFO.match(text, at + 3)):
                url_from = m.end()
                while text[url_from - 1] in ".,;:!?)":
                    url_from -= 1
                found.append((start, 4, url_from))
        elif anchor == 4:
            if at >= account_from and _alone(text, at) and (m := ACCESS_KEY.match(text, at)):
                account_from = m.end()
                found.append((at, 5, account_from))
        elif at >= account_from and _alone(text, at):
            if (m := LABELLED.match(text, last + 1)) and sum(map(str.isdigit, m[1])) >= 5:
                account_from = m.end(1)
                found.append((m.start(1), 5, account_from))
            elif text[at : last + 1].lower() == "iban":
                after = last + 1
                while after < len(text) and after < last + 4 and text[after] in " :=#":
                    after += 1
                if (m := IBAN.match(text, after)) and mod97(m[0].replace(" ", "")):
                    account_from = m.end()
                    found.append((after, 5, account_from))
    found.sort()
    return found


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, the spans as arrays (``starts``, ``ends``, ``kinds``)."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [spans(t) for t in texts_of(b)]
        out = [pa.array([[x[i] for x in g] for g in got], pa.list_(pa.int32())) for i in (0, 2)]
        return pa.RecordBatch.from_arrays([b.column("id"), *out, pa.array([[KINDS[x[1]] for x in g] for g in got], pa.list_(pa.string()))], names=["id", "starts", "ends", "kinds"])

    out = arrow_map(df.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text"), fn, f"id {kind}, starts array<int>, ends array<int>, kinds array<string>")
    return out.withColumnRenamed("id", id_col)


def pii_report(df: DataFrame) -> DataFrame:
    """Counts and digests of :func:`spans` for each document, made beside the spans so that they need not leave the worker."""
    small_batches(df.sparkSession)
    types = {"doc_id": pa.int64(), "n_email": pa.int64(), "n_ip": pa.int64(), "n_card": pa.int64(), "n_phone": pa.int64(), "base_sha256": pa.string(), "spans": pa.string(), "n_spans": pa.int64()}

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [spans(t) for t in texts_of(b)]
        out: dict[str, object] = {"doc_id": b.column("doc_id")}
        for i, name in enumerate(("n_email", "n_ip", "n_card", "n_phone")):
            out[name] = [sum(x[1] == i for x in g) for g in got]
        out["base_sha256"] = [hashlib.sha256(written([x for x in g if x[1] < BASE]).encode()).hexdigest() for g in got]
        out["spans"] = [written(g) for g in got]
        out["n_spans"] = [len(g) for g in got]
        return batch_of(out, types)

    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint"
    return arrow_map(df.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text"), fn, schema)


def masked(text: str) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out: list[str] = []
    done = 0
    for start, end, kind in _merged(spans(text)):
        out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = end
    return "".join([*out, text[done:]]) if out else text


def _merged(found: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    now: tuple[int, int, int] | None = None
    for start, kind, end in found:
        if now and start < now[1]:
            now = (now[0], max(now[1], end), now[2])
        else:
            if now:
                yield now
            now = (start, end, kind)
    if now:
        yield now


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data in ``text_col`` masked (a null text stays null)."""
    small_batches(df.sparkSession)
    at = place_of(df, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([None if t is None else masked(t) for t in b.column(at).to_pylist()], b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([new if i == at else b.column(i) for i in range(b.num_columns)], schema=b.schema)

    return df.mapInArrow(run, df.schema)

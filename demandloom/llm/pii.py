"""Personal data: patterns propose spans, checksums confirm, nearby words adjust the score.

Base kinds (a pattern's leftmost matches that do not overlap; a match that fails
its check is dropped and not tried again): ``email``, ``ip`` (parts at most 255),
``card`` (13 to 19 digits, Luhn), ``phone`` (9 to 15 digits). They always stay.
Added kinds: ``iban`` (mod-97) and ``ssn`` (a bare three-two-four digit group, which
no checksum can confirm) and ``secret`` (the value of a named setting, or a credential with a
known beginning); these stay from a score of ``least_score`` on, which
``ssn`` reaches only beside a word that speaks for it. A setting's score grows with the entropy of its value,
which is not enough on its own: its name or a word nearby has to say that it is secret. Context words are
English, German, French and Spanish.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.llm.common import slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")
SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"
WINDOW = 40
LEAST_SCORE = 0.5

# The part from the at sign on is searched, the part before it is walked back to:
# each character is looked at a bounded number of times, however long a run is.
_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_HEAD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SETTING = re.compile(r"(?<![\w.-])[^\W\d][\w.-]{0,63}[\"']? {0,3}(?::|=>?) {0,3}[\"']?(?P<value>[A-Za-z0-9_+/=.~-]{12,})")
_NAME = re.compile(r"[\w.-]+[\"']? {0,3}(?::|=>?) {0,3}[\"']?\Z")
# How some credentials begin.
_CREDENTIAL = re.compile(
    r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}"
    r"|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})(?![A-Za-z0-9])"
)
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^\W\d_]+")

# Score of a confirmed span without any context, and the words that raise or lower it.
_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
_FOR = {
    "email": set("mail email contact write address kontakt schreiben adresse courriel contacter écrire correo contacto escribir".split()),
    "ip": set("ip host server address login rechner adresse serveur hôte servidor dirección".split()),
    "card": set("card visa credit debit payment pay karte kreditkarte zahlung carte crédit paiement tarjeta crédito pago".split()),
    "phone": set("phone tel call mobile fax contact telefon handy anruf anrufen téléphone tél appeler teléfono llamar móvil".split()),
    "iban": set("iban bank account transfer konto überweisung banque compte virement banco cuenta transferencia".split()),
    "ssn": set("ssn social security insurance sozialversicherung versicherung sécurité sociale seguridad seguro".split()),
    "secret": set(
        "token secret password passwd passwort passphrase pwd apikey api key auth authorization bearer credential credentials "
        "geheim kennwort schlüssel secrète jeton clé passe secreto contraseña clave".split()
    ),
}
_AGAINST = {
    "email": {"noreply", "example"},
    "ip": set("version release build fassung versión".split()),
    "card": set("isbn serial order tracking seriennummer bestellung sendung série commande suivi serie pedido seguimiento".split()),
    "phone": set("isbn serial order tracking seriennummer bestellung sendung série commande suivi serie pedido seguimiento".split()),
    "iban": set(),
    "ssn": set("order part serial tracking bestellung teil commande pièce pedido pieza".split()),
    "secret": set("example placeholder checksum sha md5 commit hash beispiel exemple ejemplo".split()),
}
_STEP = 0.2


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (2 if place % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The check of an account number: country and check digits last, letters as 10 to 35."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for tail in _EMAIL_TAIL.finditer(text):
        start = tail.start()
        while start > done and text[start - 1] in _EMAIL_HEAD:
            start -= 1
        if start < tail.start():
            done = tail.end()
            yield start, done


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for match in _IP.finditer(text):
        parts = [part.lstrip("0") for part in match[0].split(".")]
        if all(len(part) <= 3 and int(part or 0) <= 255 for part in parts):
            yield match.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for match in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", match[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield match.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for match in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", match[0])) <= 15:
            yield match.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for match in _IBAN.finditer(text):
        # upper-case words may follow the number: the longest end at a word's end that passes
        for end in range(match.end(), match.start() + 14, -1):
            if end < len(text) and text[end].isalnum() or text[end - 1] == " ":
                continue
            account = match[0][: end - match.start()].replace(" ", "")
            if 15 <= len(account) <= 34 and mod97(account):
                yield match.start(), end
                break


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    yield from (match.span() for match in _SSN.finditer(text))


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    known = {match.start(): match.end() for match in _CREDENTIAL.finditer(text)}
    found = {**{match.start("value"): match.end() for match in _SETTING.finditer(text)}, **known}
    for start in sorted(found):
        if start >= done:
            done = found[start]
            yield start, done


def entropy(text: str) -> float:
    """Bits a character, from the frequencies within ``text``."""
    n = len(text)
    return -sum(count / n * math.log2(count / n) for count in Counter(text).values())


def _secret_score(value: str) -> float:
    """Of a value alone: at most 0.4, so that its name has to speak for it, but for known beginnings."""
    if _CREDENTIAL.fullmatch(value):
        return 0.8
    mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    return min(0.4, 0.1 * max(0.0, entropy(value) - 1)) * (1.0 if mixed else 0.5)


_FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "ssn": _ssns, "secret": _secrets}


def score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]
    words = {word.lower() for word in _WORD.findall(near)}
    if kind == "secret":  # what speaks against it is the setting's own name; words around belong to other things
        name = _NAME.search(text[max(0, start - 2 * WINDOW) : start])
        against = {word.lower() for word in _WORD.findall(name[0])} if name else set()
        value = _secret_score(text[start:end]) + 0.3 * bool(words & _FOR[kind]) - 0.3 * bool(against & _AGAINST[kind])
    else:
        value = _SCORE[kind] + _STEP * bool(words & _FOR[kind]) - _STEP * bool(words & _AGAINST[kind])
    return min(1.0, max(0.0, round(value, 3)))


def spans_of(text: str | None, least_score: float = LEAST_SCORE) -> list[tuple[str, int, int, float]]:
    """``(kind, start, end, score)`` by kind, then start; code points, end exclusive."""
    found = []
    for kind, finder in _FINDERS.items():
        for start, end in finder(text or ""):
            points = score(text, kind, start, end)
            if kind in BASE_KINDS or points >= least_score:
                found.append((kind, start, end, points))
    return found


def redacted(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """``text`` with each span as its kind in brackets; of spans that overlap, the first names them all."""
    kept, done = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda span: (span[1], -span[2])):
        if start >= done:
            kept += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*kept, text[done:]])


def find_pii(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_score: float = LEAST_SCORE
) -> DataFrame:
    """``(doc_id, spans)`` for every row, spans by kind and start with their score.

    A null or empty text has no spans. Null ids and repeated rows stay as they
    are, an empty table gives an empty table, and further columns are not read.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            spans = [
                [dict(zip(("kind", "start", "end", "score"), span)) for span in spans_of(text, least_score)]
                for text in part.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, type=_SPAN_TYPE)], names=["doc_id", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(each, f"doc_id {kind}, spans {SPAN}")


_SPAN_TYPE = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
)


def redact(
    docs: DataFrame, text_col: str = "text", length_col: str | None = None, least_score: float = LEAST_SCORE
) -> DataFrame:
    """``docs`` with every span replaced by its kind; null texts and all other columns stay as they are.

    ``length_col``, where ``docs`` has it, gets the new number of characters of changed texts.
    """
    at = docs.columns.index(text_col)
    length_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at):
            old = part.column(at).to_pylist()
            spans = [spans_of(text, least_score) for text in old]
            texts = [redacted(text, own) if own else text for text, own in zip(old, spans)]
            columns = list(part.columns)
            columns[at] = pa.array(texts, type=part.schema.field(at).type)
            if length_at is not None:
                lengths = zip(spans, texts, part.column(length_at).to_pylist())
                kind = part.schema.field(length_at).type
                columns[length_at] = pa.array([len(text) if own else n for own, text, n in lengths], type=kind)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(each, docs.schema)

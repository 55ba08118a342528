"""Personal data: patterns propose spans, checksums confirm them, context words score them.

Base kinds (email, ip, card, phone) follow fixed patterns and checks. The method adds
IBANs (mod 97), social security numbers and secrets, where context words next to a
span carry the decision. Every pattern takes time linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The order in which kinds are listed.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "secret")

#: Score of a bare pattern, of a passed checksum, and what context adds or takes.
PATTERN, CHECKSUM, NEAR, AGAINST = 0.4, 0.4, 0.3, -0.3
#: Code points on either side in which context words count.
WINDOW = 48
#: Words that speak for a kind, in English, German, French and Spanish.
CONTEXT = {
    "email": ("mail", "contact", "write", "kontakt", "schreiben", "courriel", "écrire", "correo", "contacto", "escribir"),
    "ip": ("ip", "host", "server", "address", "adresse", "serveur", "servidor", "dirección"),
    "card": ("card", "visa", "credit", "pay", "karte", "kreditkarte", "zahlung", "carte", "paiement", "tarjeta", "pago"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "anruf", "handy", "téléphone", "appeler", "teléfono", "llamar", "móvil"),
    "iban": ("iban", "account", "bank", "transfer", "konto", "überweisung", "compte", "banque", "virement", "cuenta", "banco", "transferencia"),
    "ssn": ("ssn", "social", "security", "taxpayer", "sozialversicherung", "steuernummer", "sécurité", "seguridad", "contribuyente"),
    "secret": ("password", "passwd", "token", "secret", "api_key", "apikey", "passwort", "kennwort", "geheim", "mot de passe", "contraseña", "clave", "secreto"),
}
#: Words that speak against any kind.
COUNTER = (
    "version", "isbn", "example only", "order no", "serial", "seriennummer", "bestellnummer", "nur ein beispiel", "numéro de série", "commande no", "exemple",
    "versión", "número de serie", "pedido no", "ejemplo",
)

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++){0,3}+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])[0-9a-f]{16,128}(?![A-Za-z0-9])")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        total += _DOUBLED[int(d)] if i % 2 else int(d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern local@domain finds them from the left, found from the @ signs."""
    done = at = 0
    while m := _DOMAIN.search(text, at):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            done = at = m.end()
        else:
            at = m.start() + 1


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        if len(parts) == 4 and all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in parts):
            yield m.span()


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() < 13:
            continue
        digits = _only_digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_only_digits(m[0])) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        found = m[0]
        while len(found) > 14 and not mod97(found.replace(" ", "")):
            found = found[: max(found.rfind(" "), 0)]  # a word behind the number is no part of it
        if len(found) > 14:
            yield m.start(), m.start() + len(found)


def _plain(pattern: re.Pattern) -> object:
    return lambda text: (m.span() for m in pattern.finditer(text))


_FINDERS = {
    "email": (_emails, PATTERN + CHECKSUM), "ip": (_ips, PATTERN + CHECKSUM), "card": (_cards, PATTERN + CHECKSUM),
    "phone": (_phones, PATTERN), "iban": (_ibans, PATTERN + CHECKSUM), "ssn": (_plain(_SSN), PATTERN), "secret": (_plain(_SECRET), PATTERN),
}
_NEAR_RE = {k: re.compile(r"(?<![a-zà-öø-ÿ])(?:" + "|".join(map(re.escape, v)) + r")(?![a-zà-öø-ÿ])") for k, v in CONTEXT.items()}
_AGAINST_RE = re.compile("|".join(map(re.escape, COUNTER)))


def find_spans(text: str, threshold: float = 0.6) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in order of kind, then start; code points, end exclusive.

    Base spans stay whatever their score; the others need ``threshold``.
    """
    found = []
    for kind in KINDS:
        finder, base = _FINDERS[kind]
        for start, end in finder(text):
            around = f"{text[max(0, start - WINDOW) : start]} {text[end : end + WINDOW]}".lower()
            score = base + (NEAR if _NEAR_RE[kind].search(around) else 0) + (AGAINST if _AGAINST_RE.search(around) else 0)
            score = round(min(1.0, max(0.0, score)), 3)
            if kind in BASE or score >= threshold:
                found.append((kind, start, end, score))
    return found


SPAN = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType(), False),
            T.StructField("start", T.IntegerType(), False),
            T.StructField("end", T.IntegerType(), False),
            T.StructField("score", T.DoubleType(), False),
        ]
    )
)
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def detect_pii(docs: DataFrame, *, threshold: float = 0.6, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``pii``, an array of (kind, start, end, score).

    Whole texts are scanned in Arrow batches, without a shuffle. Null or empty text has
    no spans (an empty array). Rows that repeat are each given their spans. A very long text
    takes time in proportion to its length, in one task. An empty table gives an empty
    table. A column of ``docs`` named ``pii`` is replaced; others may have any name.
    """
    docs = docs.drop("pii")
    schema = T.StructType([*docs.schema.fields, T.StructField("pii", SPAN)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            spans = [
                [dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find_spans(t or "", threshold)]
                for t in batch.column(at).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(spans, _ARROW)], names=[*batch.schema.names, "pii"]
            )

    return docs.mapInArrow(run, schema)

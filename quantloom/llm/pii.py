"""Personal data: generators propose overlapping spans, boosted trees judge them, thresholds select.

The four strict patterns (email, ip, card, phone) are always taken. Looser generators add spans of the same
kinds and of two more (ssn, iban) where no strict span holds them already; for those a boosted model over format and context features gives a
calibrated probability, and a span is selected from its kind's threshold on. The model is trained on the
driver from generated examples, so it needs no table and is the same in every run.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.boosting import Boosted, least_threshold
from quantloom.llm.text import documents, map_arrow, only

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "iban")
PRECISION = 0.98
EXAMPLES = 4000
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

_LOCAL = "A-Za-z0-9._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A digit run is entered at its first digit only: a match that fails there fails from each later digit, too.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_LOCAL_END = re.compile(rf"[{_LOCAL}]*\Z")

# Loose generators; each can propose what another or a strict pattern proposes, too.
_LOOSE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z]{2,12}){1,3}", re.I | re.A)),
    ("phone", re.compile(r"(?<![0-9])(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ .-][0-9]{4}){2}[ .-][0-9]{1,7}(?![0-9])")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}(?![0-9.])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
)
#: Words that stand near each kind, in English, German, French, Spanish and Italian; those of "none" tell of look-alikes.
WORDS = {
    "email": "mail contact write reach kontakt schreiben courriel écrire contacter correo escribir scrivere posta",
    "phone": "phone call tel fax mobile cell whatsapp telefon anrufen rufnummer téléphone appeler teléfono telefono llamar móvil chiamare cellulare",
    "ssn": "ssn social security tax steuer sozialversicherung sécurité sociale seguridad social fiscale",
    "card": "card visa credit debit payment karte kreditkarte zahlung carte paiement tarjeta pago carta pagamento",
    "ip": "ip host server address login adresse serveur servidor dirección indirizzo",
    "iban": "iban bank account transfer konto überweisung banque compte virement banco cuenta conto bonifico",
    "none": "version order invoice ref page part serial build release total isbn bestellung rechnung seite commande facture pedido factura página ordine fattura pagina",
}
_CONTEXT = tuple((k, re.compile(r"(?<![^\W_])(?:" + "|".join(w.split()) + ")", re.I)) for k, w in WORDS.items())
CONTEXT_CHARS = 40


def mod97(span: str) -> bool:
    """Whether an account number's check digits are right."""
    text = span.replace(" ", "").upper()
    moved = text[4:] + text[:4]
    return len(text) >= 15 and moved.isascii() and moved.isalnum() and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards, so long runs without one cost nothing."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))
    return out


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the strict patterns, by kind and start."""
    out = [("email", *x) for x in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """All that the loose generators propose; spans may overlap."""
    digit, out = bool(_DIGIT.search(text)), []
    for kind, pattern in _LOOSE:
        if kind == "email":
            low = text.lower()  # the pattern takes either case
            if "@" in low or "(at)" in low or "[at]" in low:
                out += [(kind, *m.span()) for m in pattern.finditer(text)]
        elif digit:
            out += [(kind, *m.span()) for m in pattern.finditer(text)]
    return sorted(set(out), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span and of what surrounds it."""
    span, before, after = text[start:end], text[max(0, start - CONTEXT_CHARS) : start], text[end : end + CONTEXT_CHARS]
    digits = _NOT_DIGIT.sub("", span)
    parts = [int(x) for x in re.findall("[0-9]{1,9}", span)]
    near_left, near_right = text[start - 1 : start], text[end : end + 1]
    return [
        *(float(kind == k) for k in KINDS),
        float(len(span)),
        float(len(digits)),
        len(digits) / len(span),
        float(sum(not c.isalnum() for c in span)),
        float(len(set(digits))),
        float(12 <= len(digits) <= 19 and luhn(digits)),
        float(max(parts, default=0) <= 255),
        float(len(parts)),
        float(span[:1] == "0" or digits[:3] in ("000", "666") or digits[:1] == "9"),
        float("@" in span),
        float(kind == "iban" and mod97(span)),
        float(near_left.isalnum() or near_left in ("/", "_", "#")),
        float(near_right.isalnum() or near_right in ("/", "_", "%")),
        float(sum(c.isdigit() for c in before)),
        *(float(bool(p.search(before))) for _, p in _CONTEXT),
        *(float(bool(p.search(after))) for _, p in _CONTEXT),
    ]


def generated(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the candidates in n generated sentences, half with personal data, half with look-alikes."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    name = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(3, 9))))

    def card() -> str:
        head = pick("3456") + num(14)
        return head + next(d for d in "0123456789" if luhn(head + d))

    def iban() -> str:
        land, body = pick(["DE", "FR", "ES", "GB", "IT", "NL"]), num(int(rng.integers(11, 24)))
        return next(x for x in (f"{land}{c:02d}{body}" for c in range(2, 99)) if mod97(x))

    def group(digits: str, sep: str) -> str:
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))

    real = {
        "email": lambda: f"{name()}{pick(['.', '_', ''])}{name()}{pick(['@', ' (at) ', ' [at] ', '(at)'])}{name()}{pick(['.', '.', ' (dot) '])}{pick(['com', 'org', 'net', 'io'])}",
        "phone": lambda: pick([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"0{num(2)} {num(3)} {num(4)}", f"0{num(3)} {num(4)} {num(3)}", f"{num(2)} {num(3)} {num(4)}"]),
        "ssn": lambda: f"{int(rng.integers(1, 665)):03d}-{int(rng.integers(1, 99)):02d}-{num(4)}",
        "card": lambda: group(card(), pick([" ", "-", "."])),
        "ip": lambda: pick([" . ", ". ", "."]).join(str(int(x)) for x in rng.integers(0, 256, 4)),
        "iban": lambda: group(iban(), pick(["", " "])),
    }
    fake = {
        "email": lambda: f"{name()} @ {name()} . {name()[:4]}",
        "phone": lambda: pick([f"{num(4)} {num(4)} {num(4)}", f"{num(2)}.{num(3)}.{num(3)}", f"{num(3)} {num(3)} {num(3)}"]),
        "ssn": lambda: f"{pick(['000', '666', '9' + num(2)])}-{num(2)}-{num(4)}",
        "card": lambda: group(next(x for x in iter(lambda: num(16), "") if not luhn(x)), pick([" ", "-"])),
        "ip": lambda: ".".join(str(int(x)) for x in rng.integers(0, 999, 4)),
        "iban": lambda: group(name()[:2].upper() + num(16 + 4 * int(rng.integers(0, 2))), ""),
    }
    rows, labels = [], []
    for i in range(n):
        kind, good = pick(list(real)), bool(i % 2)
        value = (real if good else fake)[kind]()
        near = pick(WORDS[kind].split()) if rng.random() < (0.8 if good else 0.15) else pick(WORDS["none"].split()) if not good and rng.random() < 0.7 else name()
        lead, tail = (near, name()) if rng.random() < 0.8 else (name(), near)
        text = f"{name()} {name()} {lead}{pick([': ', ' ', ' is '])}{value}{pick(['', '.', ',', ' '])} {tail} {name()}"
        at = text.index(value)
        for k, s, e in candidates(text):
            rows.append(features(text, k, s, e))
            labels.append(float(good and k == kind and s <= at + 1 and e >= at + len(value) - 1))
    return np.array(rows), np.array(labels)


@lru_cache(maxsize=1)
def model() -> tuple[Boosted, dict[str, float]]:
    """Trees, and each kind's threshold: the least calibrated probability with PRECISION on held-out examples."""
    x, y = generated(EXAMPLES)
    part = np.arange(len(y)) % 4
    trees = Boosted().fit(x[part < 2], y[part < 2]).calibrate(x[part == 2], y[part == 2])
    x, y = x[part == 3], y[part == 3]
    p = trees.probability(x)
    return trees, {k: least_threshold(p[x[:, i] > 0], y[x[:, i] > 0], PRECISION) for i, k in enumerate(KINDS)}


Judge = tuple[Boosted, dict[str, float]]


def find_all(texts: list[str], judge: Judge) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """For each text its strict spans and all spans, both by start and kind."""
    trees, least = judge
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    base = [sorted(base_spans(t), key=order) for t in texts]
    more = [[c for c in candidates(t) if not any(s <= c[1] and c[2] <= e for _, s, e in b)] for t, b in zip(texts, base, strict=True)]
    rows = [features(t, *c) for t, cs in zip(texts, more, strict=True) for c in cs]
    p = iter(trees.probability(np.array(rows)) if rows else ())
    return [(b, sorted(set(b) | {c for c in cs if next(p) >= least[c[0]]}, key=order)) for b, cs in zip(base, more, strict=True)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Overlapping spans become one mark, named after the first of them."""
    out, at = [], 0
    for kind, s, e in spans:
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def find(docs: DataFrame) -> DataFrame:
    """SCHEMA for each row of docs. Null text: empty, which holds nothing; a null doc_id stays null; repeated
    rows repeat; an empty table gives an empty one. Texts are searched in whole, in time linear in their length."""
    judge = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find_all(batch.column("text").to_pylist(), judge)
            count = [pa.array([sum(x[0] == k for x in b) for b, _ in found], pa.int64()) for k in BASE]
            sha = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *count, sha, pa.array([joined(a) for _, a in found], pa.string())], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return map_arrow(only(docs), run, SCHEMA)


def redact(docs: DataFrame) -> DataFrame:
    """docs with all selected spans in text replaced by <KIND> and n_chars counted anew; other columns and the
    order of columns stay. Null texts stay null."""
    judge = model()

    @F.pandas_udf("string")
    def clean(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        held = [t or "" for t in texts]
        return pd.Series([None if t is None else redacted(h, a) for t, h, (_, a) in zip(texts, held, find_all(held, judge), strict=True)], dtype=object)

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    out = docs.withColumn("text", clean(docs["text"].cast("string")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir))

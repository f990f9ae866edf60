"""Secret scan by dictionary-primed compression.

Three strict patterns (assign, access, hex) are always reported. Further strings that stand in a sensitive
context are candidates: zstandard, primed with a dictionary of code identifiers, compresses the surrounding
text with and without the candidate, and the marginal bytes are its novelty. Names and prose that the
dictionary or the surroundings explain cost little; a candidate that stays incompressible is reported.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from quantloom.llm.text import documents, map_arrow, only

KINDS = ("assign", "access", "hex", "novel")
#: Characters before and after a candidate that prime its compression.
CONTEXT_CHARS = 256
#: Characters before a candidate in which a sensitive word must stand.
SENSITIVE_CHARS = 48
#: Marginal bits per character from which a candidate counts as random (prose: about 2.5 to 4; base64 at random: 6).
MIN_BITS = 4.6
MIN_CHARS = 16
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_NOVEL = re.compile(rf"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{{{MIN_CHARS},}}+(?![A-Za-z0-9+/_=.-])")
_SENSITIVE_WORDS = ("key", "secret", "token", "auth", "credential", "passw", "pwd", "bearer", "private", "session", "signature", "cookie")
_SENSITIVE = re.compile("|".join(_SENSITIVE_WORDS), re.I | re.A)

# Identifiers that code around credentials is made of.
IDENTIFIERS = """
accessToken access_token account accountId apiKey api_key application argument array assert async attribute auth
authenticate authorization await backend base64 basic bearer binary boolean buffer bytes cache callback certificate
class client clientId client_id client_secret compile config configuration connect connection const constant container
content context controller cookie credential credentials database debug decode default define delete deploy description
development digest directory document element encode encoding encrypt endpoint environment error event example exception
execute export expression extends false fetch field file filename filter final float format function generate handler
hash header headers host hostname identifier implements import index initialize input instance integer interface
internal iterator json keystore lambda length library license listener local localhost logger login manager master
message metadata method module namespace network node null number object option options output package parameter params
parse parser password path pattern payload permission placeholder port prefix primary private process production
profile project property protected protocol provider proxy public publicKey query random read refresh refresh_token
register release remote render request require resource response result return schema scope script secret secretKey
secret_key security select server service session settings signature socket source staging static status storage stream
string struct system table template test thread timeout timestamp token trigger true type undefined update upload url
user username uuid validate value variable version virtual webhook window workspace write xml yaml
"""


@lru_cache(maxsize=1)
def _compressor() -> zstandard.ZstdCompressor:
    words = zstandard.ZstdCompressionDict(" ".join(IDENTIFIERS.split()).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(level=6)
    return zstandard.ZstdCompressor(dict_data=words, write_checksum=False, write_content_size=False)


def _blanked(near: str, word: str) -> str:
    """near with spaces for all that stands in word, too, in pieces of MIN_CHARS or more: copies, whole or in part."""
    out, shown = "", 0
    for i in range(len(near) - MIN_CHARS + 1):
        if near[i : i + MIN_CHARS] in word:
            out += near[shown:i] + " " * (i + MIN_CHARS - max(shown, i))
            shown = i + MIN_CHARS
    return out + near[shown:]


def novelty(text: str, start: int, end: int) -> float:
    """Marginal compressed bits per character of text[start:end] beside what surrounds it, other copies left out."""
    word, far = text[start:end], CONTEXT_CHARS + MIN_CHARS  # a copy that the context cuts is known by what lies outside
    before = _blanked(text[max(0, start - far) : start], word)[-CONTEXT_CHARS:]
    after = _blanked(text[end : end + far], word)[:CONTEXT_CHARS]
    around = f"{before}\n{after}\n"
    c = _compressor().compress
    return 8 * (len(c((around + word).encode())) - len(c(around.encode()))) / (end - start)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out, low = [], text.lower()  # only a quick look: the patterns decide
    if any(w in low for w in _ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [("hex", *m.span()) for m in _HEX.finditer(text)]


def novel_spans(text: str, known: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Random-looking strings in a sensitive context that no strict span overlaps."""
    low = text.lower()
    if not any(w in low for w in _SENSITIVE_WORDS):
        return []
    out = []
    for m in _NOVEL.finditer(text):
        s, e = m.span()
        if any(s < b and a < e for _, a, b in known) or not _SENSITIVE.search(text, max(0, s - SENSITIVE_CHARS), s):
            continue
        if novelty(text, s, e) >= MIN_BITS:
            out.append(("novel", s, e))
    return out


def find_all(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    base = sorted(base_spans(text), key=order)
    return base, sorted(base + novel_spans(text, base), key=order)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame) -> DataFrame:
    """SCHEMA for each row of docs. Null text: empty, which holds nothing; a null doc_id stays null; repeated
    rows repeat; an empty table gives an empty one. Offsets are code points of the whole text, ends exclusive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_all(t) for t in batch.column("text").to_pylist()]
            count = [pa.array([sum(x[0] == k for x in b) for b, _ in found], pa.int64()) for k in KINDS[:3]]
            sha = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *count, sha, pa.array([joined(a) for _, a in found], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return map_arrow(only(docs), run, SCHEMA)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))

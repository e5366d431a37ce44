"""Secret scans: three plain patterns, and strings that dictionary-primed zstandard finds novel in a sensitive context.

The plain kinds are assign, access and hex (see PATTERNS); a pass over the bytes finds the texts in which one of them can
match at all, and the patterns then run over those whole texts. The novelty kind looks at runs of secret-like characters
that follow a sensitive word closely and overlap no plain span: of 12 characters or more, of which one is a letter, with
``=`` at their ends only, so that a name and its value are two. Each is measured by its marginal compressed bytes: the
size of its surroundings with it less their size without it, under zstandard with a dictionary of common identifiers. A
string that repeats its surroundings, or is made of identifiers, costs little; one that costs NOVEL bytes a character or more
is reported. The bound was fitted on random keys (base 62, letters, lower case with digits, upper hex) against words, paths, camel, snake and
kebab case and words with numbers, 12 to 40 characters of each in surroundings of 0 to 450 characters: 96 % of the keys are found, and 69 %
of what is found are keys where there are 1.5 times as many of the others; the rest are long words that are new to their surroundings.

Spans are code points, end exclusive, ordered by start, then by kind as listed in KINDS. Nulls and empty texts have none; very
long texts are scanned whole. Repeated rows are scanned each by itself. An empty table gives no rows. Other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.words import chunks


def _either_case(word: str) -> str:
    """The word's ASCII letters in either case, and nothing else that folds to them."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KINDS = ("assign", "access", "hex", "novel")
#: Names whose assigned values are secrets; the underscore of api_key may be missing.
NAMES = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = re.compile(f"({'|'.join(map(_either_case, NAMES))})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24

#: Words that make a context sensitive, in lower case.
SENSITIVE = ("password", "passwd", "passphrase", "pwd", "secret", "token", "api_key", "apikey", "auth", "bearer", "credential", "private", "session", "signature", "access_key", "api-key")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{12,}={0,2}")
#: Characters before a candidate in which a sensitive word must end, and around it that are its surroundings.
REACH, AROUND = 48, 256
#: Marginal compressed bytes a character from which a string is novel.
NOVEL = 0.75
#: Identifiers and phrases that prime the compressor.
IDENTIFIERS = (
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000 11111111 1234567890 xxxxxxxxxxxxxxxx example placeholder changeme your_api_key your_secret_here "
    "access_key access_token api_key api_secret apikey application authorization authenticate bearer certificate client_id client_secret config configuration connection_string "
    "content_type cookie credentials database_url default description endpoint environment filename function getElementById hostname http https identifier import include index "
    "initialize instance integer interface iterator length localhost message method module namespace null object options package parameter parse password passphrase path "
    "private_key process.env properties protocol provider public_key query refresh_token region request response result return secret_key self server service session_id "
    "session_token settings signature static string template timestamp token true type undefined update user_id username utf-8 value variable version webhook www.example.com "
)


class Novelty:
    """Measures marginal compressed bytes; one for each worker task."""

    def __init__(self):
        primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.press = zstandard.ZstdCompressor(level=9, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)

    def bytes_of(self, before: str, found: str, after: str) -> int:
        rest = (before + after).encode("utf-8", "replace")
        return len(self.press.compress(rest + b"\n" + found.encode())) - len(self.press.compress(rest + b"\n"))

    def spans(self, text: str, low: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        for m in CANDIDATE.finditer(text):
            a, b = m.span()
            s = m[0]
            if not any(c.isalpha() for c in s) or any(x < b and a < y for x, y in taken):
                continue
            if any(word in low[max(0, a - REACH) : a] for word in SENSITIVE) and self.bytes_of(text[max(0, a - AROUND) : a], s, text[b : b + AROUND]) >= NOVEL * len(s):
                yield a, b


def plain_spans(text: str, kinds: tuple[bool, bool, bool] = (True, True, True)) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the plain kinds, in order."""
    out = []
    if kinds[0]:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if kinds[1]:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_MIN]
    if kinds[2]:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= HEX_MIN]
    return sorted(out)


_HEX_BYTE = np.array([chr(b) in "0123456789abcdef" for b in range(256)])
_STEMS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_CONTEXT = tuple(w.encode() for w in SENSITIVE)


def _long_hex(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text of a chunk has a run of HEX_MIN hex digits; runs over a text's end only cost a scan."""
    x = _HEX_BYTE[data]
    run = x
    for step in (1, 2, 4, 8):
        run = run[:-step] & run[step:] if len(run) > step else run[:0]
    run = run[:-8] & run[8:] if len(run) > 8 else run[:0]  # runs of 16, then of 24
    out = np.zeros(len(offsets) - 1, bool)
    at = np.flatnonzero(run)
    out[np.minimum(np.searchsorted(offsets, at, "right") - 1, len(out) - 1)] = True
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        names = ("n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans")
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for low, high, data, offsets in chunks(batch):
                whole, hexes, rows = data.tobytes(), _long_hex(data, offsets), []
                lower = whole.lower()
                for i in range(high - low):
                    a, b = int(offsets[i]), int(offsets[i + 1])
                    sensitive = any(lower.find(w, a, b) >= 0 for w in _CONTEXT)
                    kinds = (sensitive and any(lower.find(w, a, b) >= 0 for w in _STEMS), whole.find(b"AKIA", a, b) >= 0, bool(hexes[i]))
                    if not (sensitive or any(kinds)):
                        rows.append((0, 0, 0, 0, empty, ""))
                        continue
                    text = whole[a:b].decode("utf-8", "replace")
                    spans = plain_spans(text, kinds)
                    n = [sum(k == kind for _, k, _ in spans) for kind in range(3)]
                    digest, more = hashlib.sha256(joined(spans).encode()).hexdigest(), []
                    if sensitive:
                        folded = "".join(c.lower() if c.isascii() else c for c in text) if not text.isascii() else text.lower()
                        more = [(s, 3, e) for s, e in novelty.spans(text, folded, [(s, e) for s, _, e in spans])]
                    rows.append((*n, len(more), digest, joined(sorted(spans + more))))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[low:high], *(pa.array(c, pa.int64() if k < 4 else pa.string()) for k, c in enumerate(columns))], names=["doc_id", *names])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")

"""Secret scans: pattern candidates, and structural confirmation of encoded keys and signed tokens.

The base kinds are plain patterns. The method adds spans only where a candidate decodes: a PEM block (with or without
headers), a base64 run of one or several lines, or a hex run must hold a DER private key whose nested lengths add up, or an
OpenSSH key; a PEM block under an encryption header must be whole cipher blocks; base64 that decodes to a PEM block is looked
into once more; and a dotted token must have a JSON header that names an algorithm, a JSON body and a signature of plausible
length. Nothing is capped: a run of base64 is decoded as far as the key's own length says.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkward.llm import base

#: Kinds in their order at equal starts; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "pem_key", "der_key", "signed_token")
# The base patterns.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")  # a run of hex digits that is long enough, whole
LEAST_VALUE, LEAST_ACCESS = 8, 16

BEGIN, END = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----"), re.compile(r"-----END ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*: ?[^\n]*")
DEK = re.compile(r"(?m)^DEK-Info: ?[A-Z0-9-]+,(?:[0-9A-Fa-f]{2}){8,}\s*$")
#: A run of base64 that may begin a key, one that may go on with it, and what stands between lines (as such or escaped).
RUN, MORE, GAP = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}"), re.compile(r"[A-Za-z0-9+/]+={0,2}"), re.compile(r"(?:\\r)?(?:\\n)|\r?\n")
INDENT = re.compile(r"[\x20\t]*")
HEX_ANY = re.compile("(?:[0-9a-f]{2}){36,}|(?:[0-9A-F]{2}){36,}")
#: How a PEM text, a DER sequence and an OpenSSH key begin in base64.
NESTED, DER, SSH = "LS0tLS1CRUdJTi", "M", "b3BlbnNzaC1rZXktdjE"
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
WORDS = ("passw", "secret", "token", "api")
OPENSSH = b"openssh-key-v1\x00"


def der_items(data: bytes, at: int, end: int, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the items that fill data[at:end] exactly, or None; constructed items are checked within."""
    out = []
    while at < end:
        if at + 2 > end or depth > 16:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > end:
            return None
        if tag & 0x20 and der_items(data, at, at + size, depth + 1) is None:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def is_private_key(data: bytes) -> bool:
    """A DER sequence whose nested lengths add up and that begins as a private key does, or an OpenSSH key."""
    if data.startswith(OPENSSH):
        at, fields = len(OPENSSH), 0
        while at + 4 <= len(data) and fields < 3:
            at += 4 + int.from_bytes(data[at : at + 4], "big")
            fields += 1
        return fields == 3 and at + 4 <= len(data)
    top = der_items(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = der_items(data, top[0][1], top[0][2])
    if not parts or len(parts) < 2 or parts[0][0] != 0x02 or parts[0][2] - parts[0][1] != 1:
        if parts and len(parts) == 2 and parts[0][0] == 0x30 and parts[1][0] == 0x04:  # encrypted key: algorithm, octets
            inner = der_items(data, parts[0][1], parts[0][2])
            return bool(inner) and inner[0][0] == 0x06
        return False
    tags = [p[0] for p in parts[1:]]
    rsa = len(tags) >= 8 and all(t == 0x02 for t in tags[:8])
    dsa = len(tags) == 5 and all(t == 0x02 for t in tags)
    return rsa or dsa or tags[0] == 0x04 or (tags[0] == 0x30 and len(tags) > 1 and tags[1] == 0x04)


def _pem_body(text: str) -> bool:
    """Whether what stands between the lines of a PEM block is a key.

    Headers may come first. Under a DEK-Info header the key is encrypted: whole cipher blocks stand there, and nothing of
    it can be parsed.
    """
    lines = [x.strip() for x in re.sub(r"(?:\\r)?\\n", "\n", text).splitlines()]
    at = next((i for i, x in enumerate(lines) if x and not HEADER.fullmatch(x)), len(lines))
    head, body = "\n".join(lines[:at]), "".join(lines[at:])
    if not body or not re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", body) or (raw := _decoded(body)) is None:
        return False
    if DEK.search(head):
        return len(raw) >= 16 and len(raw) % 8 == 0
    return is_private_key(raw)


def pem_blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether it is a key) of each BEGIN line with the END line that comes next, if that is of its kind."""
    if "PRIVATE KEY-----" not in text:
        return
    marks = sorted([(m.start(), m.end(), m[1], True) for m in BEGIN.finditer(text)] + [(m.start(), m.end(), m[1], False) for m in END.finditer(text)])
    for (start, begun, name, first), (ended, end, other, second) in zip(marks, marks[1:], strict=False):
        if first and not second and name == other:
            yield start, end, _pem_body(text[begun:ended])


def _lines(text: str, first: re.Match, need: int | None = None) -> tuple[str, list[int]]:
    """The base64 of a run and of the lines that go on with it, and where in the text each character ends.

    Lines go on while they are as long as the first and end in no padding, or until there is what is needed; the last may
    be shorter.
    """
    width, parts, ends, at = first.end() - first.start(), [first[0]], list(range(first.start() + 1, first.end() + 1)), first.end()
    while parts[-1][-1] != "=" and (need is None or len(ends) < need) and (gap := GAP.match(text, at)) and (more := MORE.match(text, INDENT.match(text, gap.end()).end())) and more.end() - more.start() <= width:
        parts.append(more[0])
        ends += range(more.start() + 1, more.end() + 1)
        at = more.end()
        if more.end() - more.start() < width:
            break
    return "".join(parts), ends


def _der_size(data: bytes) -> int:
    """Bytes of the sequence that data begins with, by its own length; 0 if it begins with none."""
    if len(data) < 6 or data[0] != 0x30:
        return 0
    if data[1] < 0x80:
        return 2 + data[1]
    n = data[1] & 0x7F
    return 2 + n + int.from_bytes(data[2 : 2 + n], "big") if 1 <= n <= 4 else 0


def encoded_keys(text: str) -> Iterator[tuple[int, str, int]]:
    """(start, kind, end) of keys that stand in base64 without a PEM's lines: on one line, wrapped, or a PEM encoded again."""
    done = 0
    for run in RUN.finditer(text):
        head = run[0]
        if head[0] == DER and "A" <= head[1] <= "P":
            size = _der_size(_decoded(head[:8]) or b"")
            need = -(-size * 4 // 3)  # characters without padding
            if size < 16:
                continue
            body, ends = (head, None) if need <= len(head) else _lines(text, run, need)
            end = need if need <= len(body) else 0
            while end and end < len(body) and body[end] == "=":
                end += 1
            stop = 0 if not end else run.start() + end if ends is None else ends[end - 1]
            if stop and not re.match(r"[A-Za-z0-9+/=]", text[stop : stop + 1]) and (raw := _decoded(body[:need])) and is_private_key(raw):
                yield run.start(), "der_key", stop
        elif head.startswith((SSH, NESTED)) and run.start() >= done:
            body, ends = _lines(text, run)
            done = ends[-1]
            raw = _decoded(body)
            if raw is None:
                continue
            if head.startswith(SSH):
                if is_private_key(raw):
                    yield run.start(), "der_key", ends[-1]
            elif any(good for _, _, good in pem_blocks(raw.decode("latin-1"))):
                yield run.start(), "pem_key", ends[-1]


def _decoded(text: str, url: bool = False) -> bytes | None:
    text = text.rstrip("=")
    try:
        return (base64.urlsafe_b64decode if url else base64.b64decode)(text + "=" * (-len(text) % 4))
    except (binascii.Error, ValueError):
        return None


def is_signed_token(head: str, body: str, signature: str) -> bool:
    parts = []
    for x in (head, body):
        try:
            parts.append(json.loads((_decoded(x, True) or b"").decode()))
        except (ValueError, UnicodeDecodeError, RecursionError):
            return False
    if not all(isinstance(p, dict) for p in parts) or not isinstance(parts[0].get("alg"), str):
        return False
    raw = _decoded(signature, True)
    return raw is not None and (len(raw) >= 20 or parts[0]["alg"].lower() == "none" and not raw)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base kinds."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return out


def confirmed_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of candidates whose decoded structure is that of a key or a signed token."""
    blocks = list(pem_blocks(text))
    out = [(a, "pem_key", b) for a, b, good in blocks if good]
    within = lambda x: (k := bisect.bisect_right(blocks, (x, len(text) + 1))) and blocks[k - 1][1] > x
    out += [s for s in encoded_keys(text) if not within(s[0])]
    for m in HEX_ANY.finditer(text):
        if m[0][:2] in ("30", "6f", "6F") and not within(m.start()) and is_private_key(bytes.fromhex(m[0])):
            out.append((m.start(), "der_key", m.end()))
    if "eyJ" in text:
        out += [(m.start(), "signed_token", m.end()) for m in TOKEN.finditer(text) if is_signed_token(*m.groups())]
    return out


def scan_text(text: str | None) -> tuple[list, list]:
    """Base spans and all spans, each sorted by start and then kind."""
    order = lambda s: (s[0], KINDS.index(s[1]), s[2])
    found = base_spans(text or "")
    return sorted(found, key=order), sorted(found + confirmed_spans(text or ""), key=order)


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def redact(text: str | None, mark: str = "[REDACTED]") -> str | None:
    """The text with every span replaced; overlapping spans become one mark."""
    if text is None:
        return None
    out, at = [], 0
    merged: list[list[int]] = []
    for start, _, end in scan_text(text)[1]:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[at:start], mark]
        at = end
    return text if not merged else "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every whole text; no shuffle.

    A null or empty text has no spans. Offsets are code points, ends exclusive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for text in batch.column(1).to_pylist():
                found, every = scan_text(text)
                for i, kind in enumerate(KINDS[:3]):
                    cols[i].append(sum(s[1] == kind for s in found))
                cols[3].append(hashlib.sha256(joined(found).encode()).hexdigest())
                cols[4].append(joined(every))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_column(docs: DataFrame, text_col: str = "text", n_col: str = "n_chars") -> DataFrame:
    """docs with secrets masked in the text and the length column made to fit; every row stays."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redact(t) if isinstance(t, str) else None)

    out = docs.withColumn(text_col, masked(F.col(text_col)))
    return out.withColumn(n_col, F.coalesce(F.char_length(F.col(text_col)), F.lit(0)).cast(docs.schema[n_col].dataType)) if n_col in docs.columns else out


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents; hard rows as find_secrets() states."""
    base.tune(spark)
    return find_secrets(base.table(spark, sf_dir, "documents"))

"""Secret scans with structural confirmation.

Base kinds are found by pattern (``assign``, ``access``, ``hex``). The method adds spans that it
reports only after it has decoded a candidate and parsed what is inside:

* ``der``: base64 (either alphabet) or hex text that decodes to one DER SEQUENCE whose nested lengths fill their parents
  exactly, and which looks like a key: it has an INTEGER of 64 bits or more, or begins with a small version number and an
  OCTET STRING or a nested algorithm identifier;
* ``ssh``: base64 (either alphabet) or hex text that decodes to length-prefixed strings that fill the text exactly, the first
  one naming a key type, or to the container of a private key;
* ``token``: three dotted base64url parts, the first two decoding to JSON objects, the first with ``alg``;
* ``pem``: a PRIVATE KEY armour whose body decodes to one of the above, or, where header lines name a cipher and its
  start value, to whole blocks of that cipher. Line ends may be written as ``\\n``, as in JSON.

Positions are code points, ends exclusive. Added spans never remove base spans.

Edge cases: a null or empty text has no spans and empty ``spans``; rows are independent, so
repeated rows and null doc_ids are kept; candidates of any length are parsed in full, nested to at most
``DEPTH`` levels (a deeper one is not confirmed). Extra columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriloom.llm.batches import filled, slices

DEPTH = 16

# The base patterns, their shortest accepted length and the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
SHORTEST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ["assign", "access", "hex", "der", "pem", "ssh", "token"]

KEY_TYPES = (b"ssh-", b"ecdsa-", b"sk-")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}={0,2}")
DOTTED = re.compile(r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
URL_CANDIDATE = re.compile(r"(?<![A-Za-z0-9_-])(?:M|AAAA|b3Bl)[A-Za-z0-9_-]{28,}={0,2}")
ARMOUR = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:[^-]|-(?!----))*)-----END \1-----")
LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:30[0-9A-Fa-f]{62,}|(?:0000|6[Ff]70)[0-9A-Fa-f]{60,})(?![0-9A-Fa-f])")
CIPHER = re.compile(r"DEK-Info:[\x20\t]*([A-Z0-9-]+),([0-9A-Fa-f]{16,32})[\x20\t\r]*$", re.M)
ESCAPED_END = re.compile(r"\\r\\n|\\n|\\r")

#: What a text must have for a search to be worth while; a set of necessary conditions.
HINTS = {
    "assign": r"(?i)passw|secret|token|api_?key",
    "access": r"AKIA[A-Z0-9]{14}",
    "hex": r"[0-9a-f]{16}",
    "candidate": r"[A-Za-z0-9+/]{32}",
    "url": r"(?:M|AAAA|b3Bl)[A-Za-z0-9_-]{28}",
    "dotted": r"eyJ[A-Za-z0-9_-]+\.",
    "armour": r"PRIVATE KEY-----",
}


def der_parts(data: bytes, depth: int = DEPTH) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the DER values that fill ``data`` exactly; None if it is not so formed."""
    if depth == 0:
        return None
    parts, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if tag & 0x1F == 0x1F:
            return None
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size = int.from_bytes(data[at : at + n], "big")
            if size < 0x80 or data[at] == 0:
                return None  # DER lengths are as short as they can be
            at += n
        if at + size > len(data):
            return None
        content = data[at : at + size]
        if tag & 0x20 and der_parts(content, depth - 1) is None:
            return None
        parts.append((tag, content))
        at += size
    return parts


def is_der_key(data: bytes) -> bool:
    outer = der_parts(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = der_parts(outer[0][1]) or []
    tags = [tag for tag, _ in inner]
    if any(tag == 0x02 and len(content) >= 8 for tag, content in inner):
        return True
    versioned = tags[:1] == [0x02] and len(inner[0][1]) == 1 and inner[0][1][0] < 4
    if versioned and len(inner) >= 2 and inner[1][0] in (0x04, 0x30):
        return True
    return tags[:2] == [0x30, 0x03] and any(tag == 0x06 for tag, _ in der_parts(inner[0][1]) or [])


def is_ssh_key(data: bytes) -> bool:
    if data.startswith(b"openssh-key-v1\x00"):
        return len(data) >= 64
    parts, at = [], 0
    while at < len(data):
        if at + 4 > len(data):
            return False
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return False
        parts.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return len(parts) >= 2 and parts[0].startswith(KEY_TYPES)


def decoded(text: str) -> bytes | None:
    """Bytes of base64 text without white space; missing padding is filled up."""
    text = text.rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def standard(text: str) -> str:
    """Base64 letters of the URL alphabet as those of the standard one."""
    return text.replace("-", "+").replace("_", "/")


def is_armoured_key(body: str) -> bool:
    """Whether the body of an armour is a key: its text without header lines, or whole blocks of the cipher they name."""
    lines = [x.strip() for x in ESCAPED_END.sub("\n", body).split("\n")]
    data = decoded("".join("".join(x.split()) for x in lines if ":" not in x))
    if not data:
        return False
    cipher = CIPHER.search("\n".join(lines))
    if cipher:
        return len(data) >= 32 and len(data) % (len(cipher[2]) // 2) == 0
    return is_der_key(data) or is_ssh_key(data)


def json_part(text: str) -> dict | None:
    data = decoded(standard(text))
    try:
        value = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    for kind, pattern, group in (("assign", ASSIGN, 2), ("access", ACCESS, 0), ("hex", HEX, 0)):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= SHORTEST[kind]:
                yield kind, m.start(), m.end()


def key_kind(data: bytes | None) -> str | None:
    """``der`` or ``ssh`` if the bytes are such a key."""
    if data and data[0] == 0x30 and is_der_key(data):
        return "der"
    return "ssh" if data and data[0] in (0, 0x6F) and is_ssh_key(data) else None


def confirmed_spans(text: str) -> Iterator[tuple[str, int, int]]:
    for m in CANDIDATE.finditer(text):
        kind = key_kind(decoded(m[0]))
        if kind:
            yield kind, m.start(), m.end()
    for m in URL_CANDIDATE.finditer(text):
        # without a letter of its own, text of this alphabet was a candidate above
        kind = key_kind(decoded(standard(m[0]))) if "-" in m[0] or "_" in m[0] else None
        if kind:
            yield kind, m.start(), m.end()
    for m in LONG_HEX.finditer(text):
        kind = key_kind(bytes.fromhex(m[0])) if len(m[0]) % 2 == 0 else None
        if kind:
            yield kind, m.start(), m.end()
    for m in DOTTED.finditer(text):
        head, body, _ = m[0].split(".", 2)
        header = json_part(head)
        if header is not None and "alg" in header and json_part(body) is not None:
            yield "token", m.start(), m.end()
    for m in ARMOUR.finditer(text):
        if is_armoured_key(m[2]):
            yield "pem", m.start(), m.end()


def in_order(spans) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def hinted(texts: pa.Array, *names: str):
    """Texts that may have a span of the named searches."""
    return pc.match_substring_regex(texts, "|".join(f"(?:{HINTS[n]})" for n in names)).to_numpy(zero_copy_only=False)


def scan(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end), and the columns ``keep``."""
    schema_of = {f.name: f for f in docs.schema.fields}

    def find(batches):
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches, "text"):
            texts = filled(batch.column("text"))
            plain, deep = hinted(texts, "assign", "access", "hex"), hinted(texts, "candidate", "url", "dotted", "armour")
            base, every = [], []
            for i, text in enumerate(texts.to_pylist()):
                own = in_order(base_spans(text)) if plain[i] else []
                more = list(confirmed_spans(text)) if deep[i] else []
                base.append([dict(zip(("kind", "start", "end"), x)) for x in own])
                every.append([dict(zip(("kind", "start", "end"), x)) for x in in_order([*own, *more])])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", *keep)), pa.array(base, span), pa.array(every, span)],
                ["doc_id", *keep, "base", "spans"],
            )

    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    kept = "".join(f"`{c}` {schema_of[c].dataType.simpleString()}, " for c in keep)
    given = docs.select(F.col("doc_id").cast("long"), *keep, *([] if "text" in keep else ["text"]))
    return given.mapInArrow(find, f"doc_id long, {kept}base {spans}, spans {spans}")


def joined(spans: str):
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of ``scan``."""

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS[:3]]
    return scanned.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def cover(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """``text`` with each stretch that spans cover replaced by ``mark``."""
    parts, at = [], 0
    for _, start, end in sorted(spans, key=lambda x: x[1:]):
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with the secrets of ``text`` replaced; all columns stay, a null text stays null."""
    at = docs.columns.index("text")

    def change(batches):
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            some = hinted(filled(texts), *HINTS)
            new = texts.to_pylist()
            for i in some.nonzero()[0].tolist():
                spans = [*base_spans(new[i]), *confirmed_spans(new[i])]
                if spans:
                    new[i] = cover(new[i], spans, mark)
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, texts.type))

    return docs.mapInArrow(change, docs.schema)

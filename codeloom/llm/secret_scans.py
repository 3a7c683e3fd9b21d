"""Secret scans with structural confirmation.

Assignments, access keys and hex runs are found by pattern. Beyond them, a
candidate is reported only when its decoded bytes have the structure of a
secret: nested DER lengths of a private key, the length-prefixed fields of an
OpenSSH key, the packets of a PGP key, or a signed token whose header and
claims are JSON objects. Base64 may be wrapped into lines.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.common import Sealed

#: Order of kinds among spans with one start; the first three are the base.
KINDS = ("assign", "access", "hex", "signed_token", "pem_key", "base64_key", "hex_key", "openssh_key", "wrapped_pem")


def _either(word: str) -> str:
    """ASCII letters in either case, as plain sets (faster than a flag)."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
# A maximal run is taken whole, so asking for its least length in the pattern
# gives the same matches as filtering afterwards.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
# Looks ahead, so that each part of a dotted run may begin a token.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(?=(eyJ[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*){2,4}))eyJ")
BEGIN = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?)-----")
END = re.compile(r"-----END ((?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?)-----")
# The first byte of a DER sequence, 0x30, makes M and one of A-P in base64.
DER64 = re.compile(r"(?<![A-Za-z0-9+/_-])M[A-P][A-Za-z0-9+/_-]{38,}={0,2}")
DER16 = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{78,}")
SSH64 = re.compile(r"(?<![A-Za-z0-9+/])b3BlbnNzaC1rZXktdjEA[A-Za-z0-9+/]{60,}={0,2}")
PEM64 = re.compile(r"(?<![A-Za-z0-9+/_-])LS0tLS1CRUdJTi[A-Za-z0-9+/_-]{60,}={0,2}")
# Beginnings of base64 that goes on in the following lines, and one such line.
DER64_HEAD = re.compile(r"(?<![A-Za-z0-9+/_-])M[A-P][A-Za-z0-9+/_-]{14,}")
SSH64_HEAD = re.compile(r"(?<![A-Za-z0-9+/])b3BlbnNzaC1rZXktdjEA[A-Za-z0-9+/]*")
PEM64_HEAD = re.compile(r"(?<![A-Za-z0-9+/_-])LS0tLS1CRUdJTi[A-Za-z0-9+/_-]*")
NEXT = re.compile(r"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*([A-Za-z0-9+/_-]+)")
PAD = re.compile(r"={0,2}")


def decoded(text: str) -> bytes | None:
    """Base64 of either alphabet, padding optional; None when malformed."""
    plain = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(plain) % 4 == 1:
        return None
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


#: No private key has more values than this side by side.
MOST_FIELDS = 10


class Unread:
    """Bytes of base64 characters, decoded only where they are looked at."""

    def __init__(self, chars: str, at: int, size: int):
        self.chars, self.at, self.size = chars, at, size

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, i: int | slice) -> int | bytes:
        if not isinstance(i, slice):
            return self[i : i + 1][0]
        first = i.start // 3
        quads = self.chars[self.at + first * 4 : self.at + -(-i.stop // 3) * 4]
        return decoded(quads)[i.start - first * 3 : i.stop - first * 3]


def fields(data: bytes | Unread, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER values that fill data[at:end] exactly;
    None when they don't, or are more than a key has."""
    out = []
    while at < end:
        if at + 2 > end or len(out) == MOST_FIELDS:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            wide = n & 0x7F
            if not 1 <= wide <= 4 or at + wide > end:
                return None
            n = int.from_bytes(data[at : at + wide], "big")
            at += wide
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        at += n
    return out


_INT, _OCTETS, _OID, _SEQ = 0x02, 0x04, 0x06, 0x30


def private_der(data: bytes | Unread) -> bool:
    """A sequence whose nested lengths fit and whose fields are a private
    key's: PKCS#1 or DSA integers, SEC1, PKCS#8 plain or encrypted."""
    top = fields(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != _SEQ:
        return False
    inner = fields(data, top[0][1], top[0][2])
    if not inner or len(inner) < 2:
        return False
    tags = [t for t, _, _ in inner]

    def algorithm(i: int) -> bool:
        below = fields(data, inner[i][1], inner[i][2])
        return bool(below) and below[0][0] == _OID

    if tags[0] == _INT and inner[0][2] - inner[0][1] == 1:
        version = data[inner[0][1]]
        if len(tags) in (6, 9, 10) and set(tags[:9]) == {_INT}:
            return version in (0, 1)
        if tags[1] == _OCTETS:
            return version == 1
        return len(tags) >= 3 and tags[1:3] == [_SEQ, _OCTETS] and version in (0, 1) and algorithm(1)
    return tags == [_SEQ, _OCTETS] and algorithm(0)


def openssh_size(data: bytes) -> int | None:
    """Bytes of the key that ``data`` begins with: magic, then length-prefixed
    names, options and keys; None when it is not one."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return None
    at, parts = len(magic), []
    for step in range(5):
        if step == 3:  # number of keys, a plain integer
            at += 4
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if at + n > len(data):
            return None
        parts.append(data[at : at + n])
        at += n
    return at if parts[0] and parts[4] else None


def private_openssh(data: bytes) -> bool:
    return openssh_size(data) == len(data)


def private_pgp(data: bytes) -> bool:
    """Packets whose lengths fill the data, the first one a secret key."""
    at, tags = 0, []
    while at < len(data):
        head = data[at]
        at += 1
        if not head & 0x80 or at >= len(data):
            return False
        if head & 0x40:
            tag, n = head & 0x3F, data[at]
            wide = 1 if n < 192 else 2 if n < 224 else 5 if n == 255 else 0  # no partial lengths in keys
            if wide == 2:
                n = ((n - 192) << 8) + int.from_bytes(data[at + 1 : at + 2], "big") + 192
            elif wide == 5:
                n = int.from_bytes(data[at + 1 : at + 5], "big")
        else:
            tag, wide = (head >> 2) & 0x0F, (1, 2, 4, 0)[head & 3]
            n = int.from_bytes(data[at : at + wide], "big")
        at += wide
        if not wide or at + n > len(data):
            return False
        if not tags and not (n and data[at] in (2, 3, 4, 5, 6)):  # version of the key
            return False
        tags.append(tag)
        at += n
    return bool(tags) and tags[0] == 5


def signed_token(text: str) -> bool:
    """Header and claims decode to JSON objects and the header has ``alg``;
    an encrypted token (five parts) has ``enc`` and opaque parts instead."""
    parts = text.split(".")
    try:
        header = json.loads(decoded(parts[0]) or b"")
        if not isinstance(header, dict) or not isinstance(header.get("alg"), str):
            return False
        if len(parts) == 5:
            return isinstance(header.get("enc"), str)
        return len(parts) == 3 and isinstance(json.loads(decoded(parts[1]) or b""), dict)
    except (ValueError, RecursionError):
        return False


def signed_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Spans of tokens: the first five or three parts of a dotted run, so a
    full stop or a word after a token does not hide it."""
    done = 0
    for m in TOKEN.finditer(text):
        parts = m[1].split(".")
        for n in (5, 3):
            whole = ".".join(parts[:n])
            if m.start() >= done and len(parts) >= n and signed_token(whole):
                done = m.start() + len(whole)
                yield m.start(), done
                break


def pem_blocks(text: str) -> Iterator[tuple[int, int]]:
    """Spans of PEM private keys whose body decodes to a key."""
    ends: dict[str, list[tuple[int, int]]] = {}
    for m in END.finditer(text):
        ends.setdefault(m[1], []).append(m.span())
    done = 0
    for m in BEGIN.finditer(text):
        own = ends.get(m[1])
        i = bisect_right(own, (m.end(), 0)) if own else 0
        if m.start() < done or not own or i == len(own):
            continue
        following = BEGIN.search(text, m.end(), own[i][0])
        if following:  # a later begin line owns that end
            continue
        lines = text[m.end() : own[i][0]].replace("\\n", "\n").split("\n")
        locked = any("ENCRYPTED" in x for x in lines if ":" in x)
        body = "".join(x.strip() for x in lines if ":" not in x)
        data = decoded(re.sub(r"[^A-Za-z0-9+/=]", "", body.partition("=")[0]))
        if m[1].startswith("PGP "):
            sound = data and private_pgp(data)
        else:
            sound = data and (private_der(data) or private_openssh(data) or (locked and len(data) % 8 == 0))
        if sound:
            done = own[i][1]
            yield m.start(), done


def _chars(size: int) -> int:
    """Base64 characters of so many bytes, without padding."""
    return -(-size * 4 // 3)


def der_size(data: bytes) -> int | None:
    """Bytes of the sequence whose head ``data`` begins with, when its first
    value is one that keys begin with."""
    if len(data) < 2:
        return None
    wide = data[1] & 0x7F if data[1] & 0x80 else 0
    if wide > 4 or data[1] == 0x80 or len(data) < 3 + wide or data[2 + wide] not in (_INT, _SEQ):
        return None
    return 2 + wide + (int.from_bytes(data[2 : 2 + wide], "big") if wide else data[1])


def base64_keys(text: str) -> Iterator[tuple[int, int]]:
    """Spans of DER keys in one run of base64, each as long as its own head
    says, so characters that follow without a break do not hide it."""
    for m in DER64.finditer(text):
        run = m[0].rstrip("=")
        size = der_size(decoded(run[:16]) or b"")
        need = size and _chars(size)
        if need and need <= len(run) and private_der(Unread(run, 0, size)):
            yield m.start(), m.end() if need == len(run) else m.start() + need


def hex_keys(text: str) -> Iterator[tuple[int, int]]:
    """As ``base64_keys``, for hex."""
    for m in DER16.finditer(text):
        size = der_size(bytes.fromhex(m[0][:16]))
        if size and 2 * size <= len(m[0]) and private_der(bytes.fromhex(m[0][: 2 * size])):
            yield m.start(), m.start() + 2 * size


def _openssh_chars(text: str) -> int | None:
    size = openssh_size(decoded(text[: len(text) // 4 * 4]) or b"") or openssh_size(decoded(text) or b"")
    return size and _chars(size)


def _pem_chars(text: str) -> int | None:
    for cut in (text, text[: len(text) // 4 * 4]):
        data = (decoded(cut) or b"").decode("latin-1")
        block = next(pem_blocks(data), None)
        if block and block[0] == 0:
            return _chars(block[1] + len(re.match(r"\s*", data[block[1] :])[0]))
    return None


def wrapped_der(text: str) -> Iterator[tuple[int, int]]:
    """Spans of base64 DER keys over several lines; a line must end where the
    length in the key's head does.

    Lines that follow one another are joined once, whatever number of them
    begins like a key, and a key is read at its place in what was joined, so
    the work stays in step with the length of the text.
    """
    done = edge = 0
    for m in DER64_HEAD.finditer(text):
        if m.start() >= edge:
            runs, places, ends, total, following = [m[0]], {m.start(): 0}, {len(m[0]): m.end()}, len(m[0]), m
            while following := NEXT.match(text, following.end()):
                runs.append(following[1])
                places[following.start(1)] = total
                total += len(following[1])
                ends[total] = following.end()
            edge, joined_runs = ends[total], "".join(runs)
        size = der_size(decoded(m[0][:16]) or b"")
        if m.start() < done or not size:
            continue
        at = places[m.start()]
        end = ends.get(at + _chars(size), 0)
        if end > m.end() and private_der(Unread(joined_runs, at, size)):
            done = PAD.match(text, end).end()
            yield m.start(), done


def wrapped(text: str, head: re.Pattern, start: str, chars) -> Iterator[tuple[int, int]]:
    """Spans of base64 over several lines, joined up to one that begins with
    ``start``. ``chars`` reads from what was joined how many characters the
    key has; a line must end there."""
    done = 0
    for m in head.finditer(text):
        following = NEXT.match(text, m.end())
        if m.start() < done or not following:
            continue
        runs, ends, total = [m[0]], {len(m[0]): m.end()}, len(m[0])
        while following and not following[1].startswith(start):
            runs.append(following[1])
            total += len(following[1])
            ends[total] = following.end()
            following = NEXT.match(text, following.end())
        need = chars("".join(runs))
        if len(runs) > 1 and need in ends and need != len(m[0]):
            done = PAD.match(text, ends[need]).end()
            yield m.start(), done


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all secrets, by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "eyJ" in text:
        out += [(s, 3, e) for s, e in signed_tokens(text)]
    blocks = list(pem_blocks(text)) if "-----BEGIN " in text else []
    out += [(s, 4, e) for s, e in blocks]
    out += [(s, 5, e) for s, e in base64_keys(text)]
    out += [(s, 6, e) for s, e in hex_keys(text)]
    if "b3BlbnNza" in text:
        out += [(m.start(), 7, m.end()) for m in SSH64.finditer(text) if (d := decoded(m[0])) and private_openssh(d)]
    if "LS0tLS1CRUdJTi" in text:
        for m in PEM64.finditer(text):
            if (d := decoded(m[0])) and next(pem_blocks(d.decode("latin-1")), None):
                out.append((m.start(), 8, m.end()))
    lines = [(s, 5, e) for s, e in wrapped_der(text)]
    if "b3BlbnNza" in text:
        lines += [(s, 7, e) for s, e in wrapped(text, SSH64_HEAD, "b3BlbnNzaC1rZXktdjEA", _openssh_chars)]
    if "LS0tLS1CRUdJTi" in text:
        lines += [(s, 8, e) for s, e in wrapped(text, PEM64_HEAD, "LS0tLS1CRUdJTi", _pem_chars)]
    # the body of an armoured block is reported with it
    return sorted(out + [x for x in lines if not (i := bisect_right(blocks, (x[0], 0))) or blocks[i - 1][1] <= x[0]])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """The text with the union of all spans replaced."""
    out, at, edge = [], 0, 0
    for start, _, end in spans:
        if start >= edge:
            out += [text[at if at > edge else edge : start], mark]
        edge = max(edge, end)
    return "".join(out) + text[edge:] if spans else text


_FOUND = [
    T.StructField("n_assign", T.LongType()),
    T.StructField("n_access", T.LongType()),
    T.StructField("n_hex", T.LongType()),
    T.StructField("n_confirmed", T.LongType()),
    T.StructField("base_spans", T.StringType()),
    T.StructField("spans", T.StringType()),
    T.StructField("redacted", T.StringType()),
]


def find_secrets(df: DataFrame, text: str = "text", redact: bool = True) -> DataFrame:
    """Adds to every row the counts by base kind (``n_assign``, ``n_access``,
    ``n_hex``), ``n_confirmed`` (spans of the other kinds), ``base_spans`` and
    ``spans`` (kind:start:end in code points, by start, then kind) and, with
    ``redact``, ``redacted``, the whole text with all spans replaced.

    A null text has no spans and stays null; an empty one has none. Every row
    is kept, repeated ones too; columns of these names are replaced.
    """
    found = [f for f in _FOUND if redact or f.name != "redacted"]
    own = Sealed(df, [f.name for f in found])
    kept = own.table.select(*own.columns).schema.fields
    schema = T.StructType(kept + found)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            spans = [scan(t or "") for t in texts]
            base = [[x for x in s if x[1] < 3] for s in spans]
            columns = [batch.column(f.name) for f in kept]
            columns += [pa.array([sum(x[1] == k for x in s) for s in base], pa.int64()) for k in range(3)]
            columns.append(pa.array([len(s) - len(b) for s, b in zip(spans, base)], pa.int64()))
            columns += [pa.array(map(joined, x), pa.string()) for x in (base, spans)]
            if redact:
                columns.append(pa.array([t if t is None else redacted(t, s) for t, s in zip(texts, spans)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    source = own.table.select(*own.columns, F.col(own.name(text)).alias("__text"))
    return own.restored(source.mapInArrow(rows, schema))


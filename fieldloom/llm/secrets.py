"""Secret scans with structural confirmation.

Three base patterns are searched in whole texts. On top of them, runs of base64 or hex characters and PEM blocks are
decoded and parsed: a span is reported only if its bytes are what they claim to be.

* jwt - a signed token: its header is base64url JSON with a string `alg`, its payload base64url JSON, a third part follows;
* der - base64 (of either alphabet, also wrapped into lines) or hex, either also inside a longer run, of an ASN.1 SEQUENCE whose nested lengths fit exactly and
  that has the shape of a private key: PKCS#1, DSA, SEC 1, or PKCS#8 with a key's identifier, plain or encrypted. Signatures, public keys and
  certificates are no secrets and aren't reported;
* ssh - base64 of a private key in SSH wire format (a known name, as many length-prefixed fields as private keys have, a comment or none), or of an
  openssh-key-v1 container whose parts fit;
* pem - a BEGIN/END block of a private key whose body is base64 of DER or of an openssh-key-v1 container. Line ends may be escaped (\\n
  in JSON). With a DEK-Info header the body is encrypted: whole blocks of eight bytes. The block may itself be base64.

Long runs are decoded where lengths and names are read, and as a whole only once those fit, so that a run full of beginnings costs its length.

Defined cases: null texts are empty; spans count code points, end exclusive; repeated rows are scanned each; texts of any length
are scanned whole; an empty table gives an empty result; further columns are ignored by scan() and kept by redacted().
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_RUN = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "jwt", "der", "ssh", "pem")
#: Runs of base64 of at least so many characters are decoded (24 bytes: no key is shorter).
LEAST = 32
MAGIC = b"openssh-key-v1\0"
#: Identifiers (DER contents) of key algorithms in PKCS#8 (RSA, RSA-PSS, DH, DSA, EC, X25519 to Ed448), and of
#: password-based encryption (PKCS#5, PKCS#12).
KEY_OIDS = tuple(bytes.fromhex(x) for x in ("2a864886f70d010101", "2a864886f70d01010a", "2a864886f70d010301", "2a8648ce380401", "2a8648ce3d0201", "2b656e", "2b656f", "2b6570", "2b6571"))
LOCK_OIDS = tuple(bytes.fromhex(x) for x in ("2a864886f70d0105", "2a864886f70d010c01"))
#: Fields of a private key in SSH wire format, its name included (public keys have fewer).
PRIVATE_FIELDS = {"ssh-rsa": 7, "ssh-dss": 6, "ssh-ed25519": 3, "ecdsa-sha2-nistp256": 4, "ecdsa-sha2-nistp384": 4, "ecdsa-sha2-nistp521": 4}
B64_RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}")
#: Lines of one base64 text: two or more, of which the first are of at least so many characters.
B64_LINES = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}(?:(?:\\r)?(?:\\n)[A-Za-z0-9+/_-]+|[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)+={{0,2}}")
BREAK = re.compile(r"(?:\\[rn]|\s)+")
#: What base64 of a SEQUENCE, of 0x000000, of "openssh" and of "-----BEGIN " begins with; of short SEQUENCES inside a run only with an INTEGER of a byte.
STARTS = re.compile(r"MI|M[A-P].CAQ|\AM[A-P]|AAAA|b3BlbnNza|LS0tLS1CRUdJTi")
ANY_HEX = re.compile(r"[0-9A-Fa-f]{48,}")
HEX_STARTS = re.compile(r"30(?:8[1-4]|[2-7][0-9A-Fa-f]0201)|\A30")
#: No container's cipher and no key has a longer name; no private key has more parts.
NAME, PARTS = 64, 16
Read = Callable[[int, int], bytes]
JWT = re.compile(r"(?<![A-Za-z0-9_-])(ey[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:(?:\\[rn]|\s)*[A-Za-z][A-Za-z0-9-]*:\x20[^\r\n\\]*(?=\\[rn]|[\r\n]))*)((?:[A-Za-z0-9+/=\s]|\\[rn])+)-----END \1-----")
PIECE = re.compile(r"(?:(?<!\\)|(?<=\\[rn]))[A-Za-z0-9+/_-]+")
URL_SAFE = str.maketrans("-_", "+/")
KEYWORD = re.compile(r"passw|secret|token|api_?key", re.I | re.A)


def der_fits(data: bytes, depth: int = 0) -> bool:
    """Whether data is exactly one ASN.1 value with nested lengths that fit (constructed values are entered)."""
    end = _der_end(data, 0)
    if end != len(data) or not data:
        return False
    return _der_inside(data, depth)


def _der_end(data: bytes, at: int, most: int | None = None) -> int:
    """Where the value at `at` ends, or -1 if that is beyond the most there is (of data, or of what data is the beginning of)."""
    if at + 2 > len(data) or data[at] & 0x1F == 0x1F:
        return -1
    n = data[at + 1]
    if n < 0x80:
        end = at + 2 + n
    else:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + 2 + k > len(data):
            return -1
        size = int.from_bytes(data[at + 2 : at + 2 + k], "big")
        if size < 0x80 or data[at + 2] == 0:
            return -1  # DER takes the shortest form
        end = at + 2 + k + size
    return end if end <= (len(data) if most is None else most) else -1


def _der_inside(data: bytes, depth: int) -> bool:
    if not data[0] & 0x20:
        return True
    at = 2 if data[1] < 0x80 else 2 + (data[1] & 0x7F)
    while at < len(data):
        end = _der_end(data, at)
        if end < 0 or depth > 16 or not _der_inside(data[at:end], depth + 1):
            return False
        at = end
    return at == len(data)


def _children(data: bytes) -> list[tuple[int, bytes]]:
    """Tags and contents of the values inside a constructed value whose lengths fit."""
    at, out = 2 if data[1] < 0x80 else 2 + (data[1] & 0x7F), []
    while at < len(data):
        end = _der_end(data, at)
        head = 2 if data[at + 1] < 0x80 else 2 + (data[at + 1] & 0x7F)
        out.append((data[at], data[at + head : end]))
        at = end
    return out


def der_key(data: bytes) -> bool:
    """A SEQUENCE that fits exactly and has the shape of a private key: PKCS#1, DSA, SEC 1, or PKCS#8 (plain or encrypted) with a key's identifier."""
    if len(data) < 24 or data[0] != 0x30 or not der_fits(data):
        return False
    parts = _children(data)
    tags, values = [t for t, _ in parts], [v for _, v in parts]

    def names(seq: bytes, known: tuple[bytes, ...]) -> bool:
        inside = _children(b"\x30\x00" + seq) if seq else []
        return bool(inside) and inside[0][0] == 0x06 and inside[0][1].startswith(known)

    if tags == [0x02] * 9 and values[0] == b"\0" or len(tags) == 10 and tags[:9] == [0x02] * 9 and tags[9] == 0x30 and values[0] == b"\1":
        return True  # PKCS#1, of two primes or more
    if tags == [0x02] * 6 and values[0] == b"\0":
        return True  # DSA
    if tags[:2] == [0x02, 0x04] and values[0] == b"\1" and len(values[1]) >= 16 and set(tags[2:]) <= {0xA0, 0xA1}:
        return True  # SEC 1
    if tags[:3] == [0x02, 0x30, 0x04] and values[0] in (b"\0", b"\1") and set(tags[3:]) <= {0xA0, 0x81, 0xA1}:
        return names(values[1], KEY_OIDS)
    return tags == [0x30, 0x04] and len(values[1]) >= 16 and names(values[0], LOCK_OIDS)


def _of_base64(run: str, at: int, end: int) -> tuple[Read, int]:
    """Reader and number of the bytes that run encodes from at to end; only the signs around what is asked for are decoded."""

    def read(a: int, b: int) -> bytes:
        low = a // 3
        piece = run[at + 4 * low : min(at + 4 * -(-b // 3), end)]
        return base64.b64decode(piece + "=" * (-len(piece) % 4))[a - 3 * low : b - 3 * low]

    return read, (end - at) * 3 // 4


def _of_bytes(data: bytes) -> tuple[Read, int]:
    return (lambda a, b: data[a:b]), len(data)


def _der_shaped(read: Read, size: int) -> bool:
    """Whether the first `size` bytes are a SEQUENCE of a few values that end with it, with tags that a private key can begin with."""
    tags: list[int] = []
    head = read(0, 2)
    at = 2 if head[1] < 0x80 else 2 + (head[1] & 0x7F)
    while at < size and len(tags) < PARTS:
        end = _der_end(read(at, min(at + 6, size)), 0, size - at)
        if end < 0:
            return False
        tags.append(read(at, at + 1)[0])
        at += end
    return at == size and (tags[:6] == [0x02] * 6 or tags[:2] == [0x02, 0x04] or tags[:3] == [0x02, 0x30, 0x04] or tags == [0x30, 0x04])


def _fields(read: Read, size: int, at: int, count: int) -> tuple[list[tuple[int, int]], int] | None:
    """Where count fields behind four-byte lengths lie, and where they end."""
    out: list[tuple[int, int]] = []
    while len(out) < count:
        n = int.from_bytes(read(at, at + 4), "big")
        if at + 4 > size or at + 4 + n > size:
            return None
        out.append((at + 4, at + 4 + n))
        at += 4 + n
    return out, at


def _key_name(read: Read, size: int, at: int) -> str | None:
    """The name of a key's kind that stands at `at` behind its length, if it is known."""
    n = int.from_bytes(read(at, at + 4), "big")
    name = read(at + 4, at + 4 + n).decode("latin-1") if n <= NAME and at + 4 + n <= size else ""
    return name if name in PRIVATE_FIELDS else None


def ssh_container(read: Read, size: int) -> bool:
    """openssh-key-v1: cipher, kdf and its options, as many public keys as said, and one private block that ends the data.

    Its size is whole cipher blocks; if nothing is encrypted, it begins with one check number twice.
    """
    if read(0, len(MAGIC)) != MAGIC or (head := _fields(read, size, len(MAGIC), 3)) is None:
        return False
    (cipher, kdf, options), at = head
    if cipher[1] - cipher[0] > NAME or kdf[1] - kdf[0] > NAME:
        return False
    plain = read(*cipher) == b"none"
    keys = int.from_bytes(read(at, at + 4), "big")
    if not re.fullmatch(rb"[a-z0-9@.-]+", read(*cipher)) or plain != (read(*kdf) == b"none") or plain != (options[0] == options[1]) or not 1 <= keys <= 64:
        return False
    rest = _fields(read, size, at + 4, keys + 1)
    if rest is None or rest[1] != size:
        return False
    *public, private = rest[0]
    length = private[1] - private[0]
    fits = length >= 16 and length % 8 == 0 and (not plain or read(private[0], private[0] + 4) == read(private[0] + 4, private[0] + 8))
    return fits and all(_key_name(read, end, start) for start, end in public)


def _wire_ends(read: Read, size: int) -> list[int]:
    """Where a private key in SSH wire format may end: behind its fields, or behind a comment after them."""
    name = _key_name(read, size, 0)
    if name is None or (own := _fields(read, size, 0, PRIVATE_FIELDS[name])) is None:
        return []
    if name == "ssh-ed25519" and [b - a for a, b in own[0][1:]] != [32, 64]:
        return []
    noted = _fields(read, size, own[1], 1)
    return [own[1], *([noted[1]] if noted else [])]


def ssh_key(data: bytes) -> bool:
    """A private key in SSH wire format, or the OpenSSH container."""
    read, size = _of_bytes(data)
    return ssh_container(read, size) if data.startswith(MAGIC) else size in _wire_ends(read, size)


def _b64(text: str) -> bytes | None:
    text = text.rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _json(text: str) -> object:
    raw = _b64(text.replace("-", "+").replace("_", "/"))
    try:
        return json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None


def _pem(m: re.Match) -> bool:
    """Whether a block's body is a key, or encrypted as its headers say."""
    raw = _b64(BREAK.sub("", m[3]))
    if raw is None:
        return False
    return der_key(raw) or ssh_key(raw) or ("DEK-Info:" in m[2] and len(raw) >= 24 and len(raw) % 8 == 0)


def _der_size(head: bytes) -> int | None:
    """How many bytes a SEQUENCE says that it has, its head included."""
    if len(head) < 6 or head[0] != 0x30 or head[1] == 0x80 or head[1] > 0x84:
        return None
    return 2 + head[1] if head[1] < 0x80 else 2 + (head[1] & 0x7F) + int.from_bytes(head[2 : 2 + (head[1] & 0x7F)], "big")


def _pem_end(run: str, at: int) -> int | None:
    """Where a PEM block that is itself base64 ends. It is decoded up to the dashes after its body, which has none itself."""
    size = 1 << 10
    while True:
        piece = run[at : at + size]
        raw = (_b64(piece[: len(piece) - (len(piece) % 4 == 1)]) or b"").decode("latin-1")
        dashes = [m.start() for m in re.finditer("-----", raw[: raw.find("-----END ") + 200] if "-----END " in raw else raw)]
        if len(dashes) >= 4 or at + size >= len(run):
            block = PEM.match(raw)
            return at + (block.end() * 4 + 2) // 3 if block and _pem(block) else None
        if len(dashes) == 3 and not raw.startswith("-----END ", dashes[2]) and len(raw) >= dashes[2] + 9 or len(raw) > 80 and len(dashes) < 2:
            return None
        size *= 2


def _key_at(run: str, at: int, ends: set[int]) -> tuple[int, str] | None:
    """(end, kind) of the key that begins there in a run of base64 without breaks and padding, or None. DER says itself where it ends; others end with a line."""
    last = len(run) - ((len(run) - at) % 4 == 1)
    if run[at] == "M":
        size = _der_size(_b64(run[at : at + 8]) or b"")
        if size is None or size < 24:
            return None
        end = at + (size * 4 + 2) // 3
        whole = end == len(run) or run.startswith("MI", at) or run[at + 3 : at + 6] == "CAQ"
        if end > len(run) or not whole or not _der_shaped(_of_base64(run, at, end)[0], size) or not der_key(_b64(run[at:end]) or b""):
            return None
        return end, "der"
    if run[at] == "L":
        return None if (end := _pem_end(run, at)) is None else (end, "pem")
    read, size = _of_base64(run, at, last)
    if run[at] == "b":
        return (len(run), "ssh") if size >= 24 and ssh_container(read, size) else None
    for said in sorted(_wire_ends(read, size), reverse=True):
        least = -(-said * 4 // 3)
        for n in (least + 1, least):
            if n * 3 // 4 == said and n % 4 != 1 and said >= 24 and at + n in ends:
                return at + n, "ssh"
    return None


def _hex_keys(run: str) -> Iterator[tuple[int, int]]:
    """Where DER keys lie in a run of hex digits."""
    at = 0
    while start := HEX_STARTS.search(run, at):
        a, at = start.start(), start.start() + 1
        size = _der_size(bytes.fromhex(run[a : a + 12]) if a + 12 <= len(run) else b"")
        if size is None or a + 2 * size > len(run):
            continue
        read = lambda i, j, a=a: bytes.fromhex(run[a + 2 * i : a + 2 * j])
        if _der_shaped(read, size) and der_key(read(0, size)):
            at = a + 2 * size
            yield a, at


def _encoded(text: str) -> list[tuple[int, int, str]]:
    """Keys in runs of base64: single ones, and lines joined to one."""
    found: list[tuple[int, int, str]] = []
    for lines, pattern in ((False, B64_RUN), (True, B64_LINES)):
        for m in pattern.finditer(text):
            whole = m[0].rstrip("=")
            if not STARTS.search(whole):
                continue
            pieces = [(x.start(), x.end()) for x in PIECE.finditer(whole)] if lines else [(0, len(whole))]
            run = "".join(whole[a:b] for a, b in pieces).translate(URL_SAFE)
            place = [i for a, b in pieces for i in range(a, b)] if lines else range(len(whole))
            ends = set(accumulate(b - a for a, b in pieces))
            at = 0
            while start := STARTS.search(run, at):
                at = start.start() + 1
                if (key := _key_at(run, start.start(), ends)) is None:
                    continue
                at = key[0]
                end = place[at - 1] + 1
                if at == len(run):
                    end = len(m[0])  # with its padding
                span = (m.start() + place[start.start()], m.start() + end, key[1])
                if not any(a <= span[0] and span[1] <= b for a, b, _ in found):
                    found.append(span)
    return found


def find(text: str) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) of one whole text, by start, then kind."""
    spans: list[tuple[int, int, str]] = []
    if KEYWORD.search(text):
        spans += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    hexes = [m.span() for m in HEX_RUN.finditer(text)]
    spans += [(a, b, "hex") for a, b in hexes]
    if "ey" in text and "." in text:
        for m in JWT.finditer(text):
            head = _json(m[1])
            if isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(_json(m[2]), dict):
                spans.append((*m.span(), "jwt"))
    spans += _encoded(text)
    for m in ANY_HEX.finditer(text):
        spans += [(m.start() + a, m.start() + b, "der") for a, b in _hex_keys(m[0])]
    if "-----BEGIN " in text:
        blocks = [m.span() for m in PEM.finditer(text) if _pem(m)]
        inside = {s for s in spans if s[2] in ("der", "ssh", "pem") and any(a <= s[0] and s[1] <= b for a, b in blocks)}
        spans = [s for s in spans if s not in inside] + [(*x, "pem") for x in blocks]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def _said(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_assign, n_access, n_hex, n_confirmed, base_sha256, spans."""
    id_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, texts = [], []
            for t in b.column(1):
                spans = find(t.as_py() or "")
                base = [s for s in spans if s[2] in KINDS[:3]]
                for i, k in enumerate(KINDS[:3]):
                    counts[i].append(sum(s[2] == k for s in base))
                counts[3].append(len(spans) - len(base))
                digests.append(hashlib.sha256(_said(base).encode()).hexdigest())
                texts.append(_said(spans))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(texts, pa.string())], ["k", "n_assign", "n_access", "n_hex", "n_confirmed", "base_sha256", "spans"])

    out = docs.select(key, text).mapInArrow(run, f"k {id_type}, n_assign bigint, n_access bigint, n_hex bigint, n_confirmed bigint, base_sha256 string, spans string")
    return out.withColumnRenamed("k", key)


def redact(text: str) -> str:
    """text with every found span replaced by [secret]; overlapping spans are replaced together."""
    spans = find(text)
    if not spans:
        return text
    out, at = [], 0
    merged: list[list[int]] = []
    for a, b, _ in spans:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], "[secret]"]
        at = b
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs with secrets replaced in `text` and `length` (where it exists) counted anew; null texts stay null."""
    columns, types = docs.columns, docs.schema
    i = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [None if (t := x.as_py()) is None else redact(t) for x in b.column(i)]
            arrays = list(b.columns)
            arrays[i] = pa.array(new, b.schema.field(i).type)
            yield pa.RecordBatch.from_arrays(arrays, b.schema.names)

    out = docs.mapInArrow(run, types)
    return out.withColumn(length, F.length(text).cast(types[length].dataType)) if length in columns else out

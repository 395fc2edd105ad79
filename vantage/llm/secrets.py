"""Secret scans (operator 6): a worklist of decoded layers, each rescanned.

The text itself is the first layer. A layer yields further ones: the layer with
its URL escapes unwrapped, with its Unicode escapes and HTML entities unwrapped, and one for each
printable stretch, UTF-8 or ASCII in UTF-16, that a base64 run decodes to at any of its four alignments (the run may
begin with other letters of the alphabet), or that a zlib, gzip, bzip2, xz or zstandard stream in it inflates to,
streams in streams included. A stream is known by its head: bare deflate has none and is not read. Runs on lines one after another are taken one by one and joined.
Stretches of fewer than ``SHORTEST`` characters hold no secret and no layer with one. Every layer carries for each of its characters the span of the original
text it came from, so a hit in any layer is reported in code points of the
original. The worklist ends at a fixpoint: a layer whose content and place were
seen before is not taken again, and every unwrapping is shorter than what it
unwraps, apart from inflation. A stream of any size is inflated and scanned to its end, in
parts of about ``PART`` bytes with an overlap of ``OVERLAP``, as all its hits have the span of
the stream; a base64 run in it that goes on at the end of a part is kept whole up to ``OPEN``
bytes (beyond, its parts are taken for themselves). A stream that is cut off or damaged
gives what was inflated by then. Only one part a layer is held at a time.

A hit of a decoded layer is added if it covers a decoded character and is not
a span already found. Defined cases: null and empty texts have no spans (count 0,
empty list); repeated rows are scanned each.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections import deque
from html.entities import html5
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from .common import ship, table

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|((?:\\u[0-9A-Fa-f]{4})+)|\\x([0-9A-Fa-f]{2})"
                      r"|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});|&([A-Za-z][A-Za-z0-9]{1,31};)")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[A-Za-z0-9+/_-]++)+={0,2}")
_RUN = b"\r\n=+/_-" + bytes(c for c in range(128) if chr(c).isalnum())
SHORTEST = 12  # "token:" and 6 more
_PRINTABLE = re.compile("[^\x00-\x08\x0E-\x1F\x7F\udc80-\udcff]{%d,}" % SHORTEST)
_WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){%d,}|(?:\x00[\t\n\r\x20-\x7e]){%d,}" % (SHORTEST, SHORTEST))
_BZIP2, _XZ, _ZSTD, _XZ_MEMORY = rb"BZh[1-9]1AY&SY", rb"\xfd7zXZ\x00", rb"\x28\xb5\x2f\xfd", 256 << 20
_HEAD = re.compile(b"|".join([rb"\x1f\x8b\x08", _BZIP2, _XZ, _ZSTD, *(re.escape(bytes([a, b])) for a in range(8, 128, 16) for b in range(256)
                                                  if (a << 8 | b) % 31 == 0 and not b & 32)]))  # and zlib
PART, OVERLAP, OPEN = 1 << 20, 1 << 12, 16 << 20


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of one layer, leftmost and non-overlapping per kind."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    return found + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


class _Layer:
    """Text with, for each character, its original span and whether it was decoded."""

    def __init__(self, text: str, lo: np.ndarray, hi: np.ndarray, new: np.ndarray):
        self.text, self.lo, self.hi, self.new = text, lo, hi, new


def _replaced(layer: _Layer, pieces: list[tuple[int, int, str, list[tuple[int, int]]]]) -> _Layer:
    """The layer with each piece (start, end, characters, their spans in it) put in place."""
    text, lo, hi, new, at = [], [], [], [], 0
    for start, end, chars, spans in pieces:
        text += [layer.text[at:start], chars]
        a = np.array([start + s for s, _ in spans], np.int64)
        b = np.array([start + e - 1 for _, e in spans], np.int64)
        lo += [layer.lo[at:start], layer.lo[a]]
        hi += [layer.hi[at:start], layer.hi[b]]
        new += [layer.new[at:start], np.ones(len(spans), bool)]
        at = end
    return _Layer("".join([*text, layer.text[at:]]), np.concatenate([*lo, layer.lo[at:]]),
                  np.concatenate([*hi, layer.hi[at:]]), np.concatenate([*new, layer.new[at:]]))


def _chars(raw: bytes) -> list[tuple[str, int, int]]:
    """UTF-8 characters with their byte spans; bytes that are not UTF-8 stand for themselves."""
    out, at = [], 0
    while at < len(raw):
        n = 1 + (raw[at] >= 0xC0) + (raw[at] >= 0xE0) + (raw[at] >= 0xF0)
        try:
            c = raw[at:at + n].decode()
        except UnicodeDecodeError:
            c, n = chr(raw[at]), 1
        out.append((c, at, at + n))
        at += n
    return out


def _unwrap_url(layer: _Layer) -> _Layer | None:
    pieces = []
    for m in _URL.finditer(layer.text):
        chars = _chars(bytes.fromhex(m[0].replace("%", "")))
        pieces.append((m.start(), m.end(), "".join(c for c, _, _ in chars), [(3 * a, 3 * b) for _, a, b in chars]))
    return _replaced(layer, pieces) if pieces else None


def _unwrap_unicode(layer: _Layer) -> _Layer | None:
    pieces = []
    for m in _UNICODE.finditer(layer.text):
        if m[2]:
            units = [int(m[2][i + 2:i + 6], 16) for i in range(0, len(m[2]), 6)]
            chars, spans, i = [], [], 0
            while i < len(units):
                u, n = units[i], 1
                if 0xD800 <= u < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000:
                    u, n = 0x10000 + ((u - 0xD800) << 10) + units[i + 1] - 0xDC00, 2
                chars.append("\ufffd" if 0xD800 <= u < 0xE000 else chr(u))
                spans.append((6 * i, 6 * (i + n)))
                i += n
            pieces.append((m.start(), m.end(), "".join(chars), spans))
        else:
            if m[6]:
                if m[6] in html5:
                    pieces.append((m.start(), m.end(), html5[m[6]], [(0, len(m[0]))] * len(html5[m[6]])))
                continue
            u = int(m[4]) if m[4] else int(m[1] or m[3] or m[5], 16)
            if u < 0x110000 and not 0xD800 <= u < 0xE000:
                pieces.append((m.start(), m.end(), chr(u), [(0, len(m[0]))]))
    return _replaced(layer, pieces) if pieces else None


def _decoder(head: bytes):
    """A decoder for the stream that begins with ``head``, and the errors of a damaged one."""
    if re.match(_BZIP2, head):
        return bz2.BZ2Decompressor(), OSError
    if re.match(_XZ, head):
        return lzma.LZMADecompressor(lzma.FORMAT_XZ, memlimit=_XZ_MEMORY), lzma.LZMAError
    if re.match(_ZSTD, head):
        import zstandard
        return zstandard.ZstdDecompressor(max_window_size=1 << 27).decompressobj(), zstandard.ZstdError
    return zlib.decompressobj(47), zlib.error  # zlib or gzip


def _step(d, rest):
    """The pieces that a few bytes more inflate to."""
    if isinstance(d, type(zlib.decompressobj())):
        while True:
            out = d.decompress(rest, 1 << 16)
            rest = d.unconsumed_tail
            yield out
            if d.eof or not rest and len(out) < 1 << 16:
                return
    if not hasattr(d, "needs_input"):  # zstandard gives at most what a few blocks hold
        yield d.decompress(bytes(rest))
        return
    yield d.decompress(rest, 1 << 16)
    while not d.eof and not d.needs_input:
        yield d.decompress(b"", 1 << 16)


def _inflate(chunks, state: dict):
    """What a compressed stream inflates to, piece by piece; ``state`` tells how it ended."""
    d, errors = None, ()
    try:
        for c in chunks:
            for i in range(0, len(c), 256):  # small steps: damage costs no more than one
                if d is None:
                    d, errors = _decoder(bytes(c[:16]))
                for out in _step(d, c[i:i + 256]):
                    if out:
                        yield out
                if d.eof:
                    state["end"] = True
                    return
    except errors:
        state["damaged"] = True


def _inflated(raw: memoryview):
    """The pieces that a stream inflates to, and streams in it, until nothing inflates."""
    chunks, seen = _inflate([raw], {}), set()
    while True:
        head = b""
        for c in chunks:
            head += c
            if len(head) >= OVERLAP:
                break
        chunks = chain([head], chunks)
        state, key = {}, hashlib.blake2b(head[:OVERLAP], digest_size=16).digest()
        if not _HEAD.match(head) or key in seen or not any(_inflate([head], state)) or "damaged" in state:
            return chunks
        seen.add(key)
        chunks = _inflate(chunks, {})


def _parts(chunks):
    """The pieces put together to parts that overlap and do not end in a base64 run."""
    held, due = bytearray(), PART
    for c in chunks:
        held += c
        if len(held) < due:
            continue
        cut = len(held.rstrip(_RUN))
        if len(held) - cut >= OPEN:
            cut = len(held)
        if cut > OVERLAP:
            yield bytes(held[:cut])
            del held[:cut - OVERLAP]
            due = len(held) + PART
        else:
            due = 2 * len(held)
    yield bytes(held)


def _stretches(raw: bytes):
    """Printable UTF-8 stretches, each with the byte spans of its characters."""
    text = raw.decode("utf-8", "surrogateescape")
    ends = None
    for m in _PRINTABLE.finditer(text):
        if ends is None:
            point = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            width = 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000).astype(np.int64)
            width[(point >= 0xDC80) & (point <= 0xDCFF)] = 1
            ends = np.cumsum(width)
        yield m[0], (ends - width)[m.start():m.end()], ends[m.start():m.end()]
    for m in _WIDE.finditer(raw) if b"\0" in raw else ():
        at = m.start() + 2 * np.arange(len(m[0]) // 2)
        yield m[0].replace(b"\0", b"").decode(), at, at + 2


def _unwrap_base64(layer: _Layer):
    joined = list(_WRAPPED.finditer(layer.text))
    ends, spans = [j.end() for j in joined], {j.span() for j in joined}
    for m in chain(joined, _BASE64.finditer(layer.text)):
        at = bisect_right(ends, m.start())
        in_block = m.span() not in spans and at < len(joined) and joined[at].start() <= m.start()
        chars = re.sub(r"[\r\n]", "", m[0])
        run, place = chars.rstrip("=").replace("-", "+").replace("_", "/"), None
        for skip in range(4):
            part = run[skip:]
            part = part[:len(part) - (len(part) % 4 == 1)]
            raw = base64.b64decode(part + "=" * (-len(part) % 4))
            for text, a, b in _stretches(raw):  # 3 bytes from every 4 letters
                place = _places(m) if place is None else place
                yield _Layer(text, layer.lo[place[skip + a // 3 * 4]],
                             layer.hi[place[np.minimum(len(chars), skip - (-b // 3) * 4) - 1]], np.ones(len(text), bool))
            for head in _HEAD.finditer(raw):
                stream = memoryview(raw)[head.start():]
                if in_block:  # a stream that ends with its line; others are read from the joined lines
                    state = {}
                    deque(_inflate([stream], state), 0)
                    if "end" not in state:
                        continue
                for text, _, _ in chain.from_iterable(map(_stretches, _parts(_inflated(stream)))):
                    place = _places(m) if place is None else place
                    yield _Layer(text, np.broadcast_to(layer.lo[place[skip + head.start() // 3 * 4]], len(text)),
                                 np.broadcast_to(layer.hi[place[-1]], len(text)), np.ones(len(text), bool))


def _places(m: re.Match) -> np.ndarray:
    """Where the letters of a base64 run, without line ends, are in the layer."""
    code = np.frombuffer(m[0].encode(), np.uint8)
    return m.start() + np.flatnonzero((code != 10) & (code != 13))


_HINT = re.compile(r"%[0-9A-Fa-f]{2}|\\u|\\x|&#|&[A-Za-z][A-Za-z0-9]*;|[A-Za-z0-9+/_-]{16}")


def _unwrapped(layer: _Layer):
    for nxt in (_unwrap_url(layer), _unwrap_unicode(layer)):
        if nxt is not None and nxt.text:
            yield nxt
    yield from _unwrap_base64(layer)


def find(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans with those of decoded layers, in order."""
    order = {k: i for i, k in enumerate(KINDS)}

    def sort(spans):
        return sorted(spans, key=lambda s: (s[0], order[s[2]], s[1]))
    if not text:
        return [], []
    base = scan(text)
    if not _HINT.search(text):
        return sort(base), sort(base)
    spans = set(base)
    whole = np.arange(len(text), dtype=np.int64)
    seen, work = set(), [_unwrapped(_Layer(text, whole, whole + 1, np.zeros(len(text), bool)))]
    while work:  # the newest layer first: a layer's parts are made one by one
        nxt = next(work[-1], None)
        if nxt is None:
            work.pop()
            continue
        key = (hashlib.blake2b(nxt.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(),
               int(nxt.lo[0]), int(nxt.hi[-1]))
        if key in seen:
            continue
        seen.add(key)
        work.append(_unwrapped(nxt))
        for a, b, kind in scan(nxt.text):
            if nxt.new[a:b].any():
                spans.add((int(nxt.lo[a:b].min()), int(nxt.hi[a:b].max()), kind))
    return sort(base), sort(spans)


def listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id``, base spans and all spans (arrays of kind, start, end) of every row."""
    ship(docs.sparkSession)
    item = "array<struct<kind:string,start:int,end:int>>"

    def run(batches):
        import pyarrow as pa
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            both = [find(t.as_py()) for t in b.column(1)]
            cols = [pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in x[i]] for x in both], kind)
                    for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "base", "spans"])
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, base {item}, spans {item}")


def op6_secrets(spark, sf_dir):
    """Counts and digest of the base spans, and all spans, of every document."""
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def text(col):
        return f"array_join(transform({col}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    return found.selectExpr(
        "doc_id", *(f"CAST(size(filter(base, s -> s.kind = '{k}')) AS LONG) AS n_{k}" for k in KINDS),
        f"sha2({text('base')}, 256) AS base_sha256", f"{text('spans')} AS spans")

"""Secrets in texts and in whatever is encoded inside them.

A text is the first layer of a worklist.  Each layer is scanned, and unwrapped into
further layers: percent escapes and Unicode escapes are decoded in place, base64 runs
(also across line breaks) that hold text, whatever other bytes stand around it, become layers
of their own, and so do compressed runs (base64 of gzip, zlib, bzip2, xz or zstandard data, all
members, in one another to any depth).  A layer that has been seen for the same place is not entered
again, so cycles end, and the list runs empty when no layer yields a new one.  Every layer
carries, per character, the span of the original text that it came from.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import itertools
import lzma
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
_ONE_ESCAPE = re.compile(r"\\[uUx]\{?([0-9A-Fa-f]+)\}?")
_BREAK = re.compile(r"[\x20\t]*(?:\r\n?|\n|\\r\\n|\\n)[\x20\t>]*")
_PART = (re.compile(r"[A-Za-z0-9+/]+"), re.compile(r"[A-Za-z0-9_-]+"))
#: Per alphabet: a run of several lines (real or written as \n), a run of one.
_BASE64 = tuple((re.compile(rf"(?<![{c}])[{c}]{{8,}}+(?:{_BREAK.pattern}[{c}]++)++={{0,2}}"), re.compile(rf"[{c}]{{16,}}={{0,2}}")) for c in ("A-Za-z0-9+/", "A-Za-z0-9_-"))
_ASCII = re.compile(rb"[\t-\r\x20-\x7e]{12}")
_WIDE = re.compile(rb"(?:\0[\t-\r\x20-\x7e]){12,}+(?!\0)|(?:[\t-\r\x20-\x7e]\0){12,}+|(?:\0{3}[\t-\r\x20-\x7e]){12,}+(?!\0)|(?:[\t-\r\x20-\x7e]\0{3}){12,}+")
_STRAY = re.compile("[\udc80-\udcff]")
_ZLIB = type(zlib.decompressobj())
_PIECE = 1 << 20
#: A compressed run that unfolds to more bytes than this is entered in overlapping blocks to its end and counted in
#: ``n_unopened``; so many compressions in one another, each of a layer beyond that size, are taken off.
MOST_BYTES, MOST_LARGE = 1 << 26, 100


def matches(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base rules, leftmost and non-overlapping per kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS) or not text.isascii():
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


def _member(head: bytes):
    """A decompressor for data that begins like this, None if it isn't compressed."""
    if head[:2] == b"\x1f\x8b" or (head[:1] == b"\x78" and int.from_bytes(head[:2], "big") % 31 == 0):
        return zlib.decompressobj(47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    if head[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard
        return zstandard.ZstdDecompressor().decompressobj()
    return None


def _feed(unpack, data: bytes):
    """Output of a decompressor for more input, in pieces; returns what follows the end of its member, None before the end."""
    if isinstance(unpack, (bz2.BZ2Decompressor, lzma.LZMADecompressor)):
        while True:
            out, data = unpack.decompress(data, _PIECE), b""
            yield out
            if unpack.eof:
                return unpack.unused_data
            if unpack.needs_input:
                return None
    if isinstance(unpack, _ZLIB):
        while True:
            out = unpack.decompress(data, _PIECE)
            data = unpack.unconsumed_tail
            yield out
            if unpack.eof:
                return unpack.unused_data
            if not data and len(out) < _PIECE:
                return None
    for k in range(0, len(data), 512):  # zstandard has no bound on its output: 512 bytes give 16 MB at most
        yield unpack.decompress(data[k:k + 512])
        if unpack.eof:
            return unpack.unused_data + data[k + 512:]
    return None


def _inflate(chunks):
    """All members of a compressed stream, decompressed one after the other; other data after them comes as it is, on a line of its own."""
    unpack, data, plain = None, b"", False
    for chunk in itertools.chain(chunks, [None]):
        data += chunk or b""
        while data and not plain:
            if unpack is None:
                if len(data) < 6 and chunk is not None:
                    break
                unpack = _member(data)
                if unpack is None:
                    plain = True
                    yield b"\n"
                    break
            rest = yield from _feed(unpack, data)
            data, unpack = (b"", unpack) if rest is None else (rest, None)
        if plain:
            yield data
            data = b""


def _blocks(source, block: bytearray, most: int, seen: set):
    """A stream that begins with ``block`` in blocks of ``most`` bytes that overlap by half; one that is compressed again is unpacked
    first.  Blocks that repeat come once: all of a run's layers stand at the same place."""
    for _ in range(MOST_LARGE):
        if _member(block) is None:
            break
        source, block = _inflate(itertools.chain([bytes(block)], source)), bytearray()
        for piece in source:
            block += piece
            if len(block) > 5:
                break
    for piece in itertools.chain([b""], source):
        block += piece
        while len(block) > most:
            key = hashlib.sha256(block[:most]).digest()
            if key not in seen:
                seen.add(key)
                yield bytes(block[:most])
            del block[:most - most // 2]
    if block:
        yield bytes(block)


def _unfold(data: bytes, most: int):
    """Compressed data with every compression taken off: the blocks in which they end.

    A worklist of compressed layers: what one unpacks to is entered again while it is compressed itself, and
    a layer seen before is not, so nesting of any depth and data that unpack to themselves end.
    A layer larger than ``most`` comes as None and then in blocks (``_blocks``), whatever its length.
    Unsound data come as they are, too."""
    work, seen = [data], set()
    while work:
        layer = work.pop()
        key = hashlib.sha256(layer).digest()
        if key in seen:
            continue
        seen.add(key)
        source, block, sound = _inflate([layer]), bytearray(), True
        try:
            for piece in source:
                block += piece
                if len(block) > most:
                    yield None
                    whole, block = block, bytearray()
                    yield from _blocks(source, whole, most, seen)
                    break
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
            sound = False
        except Exception as e:  # zstandard's own error
            if type(e).__name__ != "ZstdError":
                raise
            sound = False
        if block and _member(block) is not None:
            work.append(bytes(block))
        elif block:
            yield bytes(block)
        if not sound:
            yield layer


class _Whole:
    """Spans of a layer whose characters all come from the same one."""

    def __init__(self, span: tuple[int, int]):
        self.span = span

    def __getitem__(self, _):
        return self.span


def _readable(data: bytes) -> bool:
    try:
        t = data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return bool(t) and all(c.isprintable() or c in "\t\r\n\x0b\x0c" for c in t)


def _texts_of(data: bytes, at):
    """(text, its spans) of decoded bytes, of which those from a to b have the span at(a, b) (or all a ``_Whole``).

    Bytes that aren't UTF-8 become U+FFFD.  UTF-16 and UTF-32 are told by their NULs, and only their
    ASCII runs become layers.  Every match, and every run that decodes to one, takes 12 ASCII
    characters in a row, so other bytes are left unless all of them are text.
    """
    if b"\x00" in data:
        for m in _WIDE.finditer(data):
            t = m.group().replace(b"\x00", b"").decode()
            n = len(m.group()) // len(t)
            yield t, at if isinstance(at, _Whole) else [at(m.start() + k, m.start() + k + n) for k in range(0, len(t) * n, n)]
    if not _ASCII.search(data) and not _readable(data):
        return
    t = data.decode("utf-8", "surrogateescape")
    if isinstance(at, _Whole):
        spans = at
    else:
        spans, k = [], 0
        for c in t:
            n = 1 if c < "\x80" or "\udc80" <= c <= "\udcff" else len(c.encode())
            spans.append(at(k, k + n))
            k += n
    yield t if data.isascii() else _STRAY.sub("�", t), spans


def _in_place(text: str, spans: list[tuple[int, int]] | _Whole, rule: re.Pattern, decode) -> tuple[str, list[tuple[int, int]] | _Whole] | None:
    """The layer with every match of ``rule`` decoded: (characters, their widths in the match)."""
    out, at, last = [], [], 0
    whole = isinstance(spans, _Whole)
    for m in rule.finditer(text):
        got = decode(m.group())
        if got is None:
            continue
        out.append(text[last:m.start()])
        out += [c for c, _ in got]
        if not whole:
            at += spans[last:m.start()]
            k = m.start()
            for _, width in got:
                at.append((spans[k][0], spans[k + width - 1][1]))
                k += width
        last = m.end()
    if not last:
        return None
    return "".join(out) + text[last:], spans if whole else at + spans[last:]


def _percent(run: str):
    t = bytes.fromhex(run.replace("%", "")).decode("utf-8", "surrogateescape")
    return [(c if not 0xDC80 <= ord(c) <= 0xDCFF else "\ufffd", 3 * len(c.encode("utf-8", "surrogateescape"))) for c in t]


def _escapes(run: str):
    out: list[tuple[str, int]] = []
    for m in _ONE_ESCAPE.finditer(run):
        n, width = int(m.group(1), 16), m.end() - m.start()
        if out and 0xDC00 <= n <= 0xDFFF and 0xD800 <= ord(out[-1][0]) <= 0xDBFF:
            high, w = out.pop()
            out.append((chr(0x10000 + (ord(high) - 0xD800 << 10) + n - 0xDC00), w + width))
        else:
            out.append((chr(n) if n < 0x110000 else "\ufffd", width))
    return [(c if not 0xD800 <= ord(c) <= 0xDFFF else "\ufffd", w) for c, w in out]


def _base64_layers(text: str, spans: list[tuple[int, int]] | _Whole | None, most: int):
    """(layer, its spans) of what every base64 run holds, in one line or in several; None before the blocks of a layer too large for one."""
    place = (lambda a, b: (a, b)) if spans is None else (lambda a, b: (spans[a][0], spans[b - 1][1]))
    tried, inside = set(), set()
    for k, (lines, line) in enumerate(_BASE64):
        for rule in (lines, line):
            for m in rule.finditer(text):
                if rule is lines:
                    parts = [p.span() for p in _PART[k].finditer(_BREAK.sub(lambda b: " " * len(b.group()), m.group()))]
                    where = [m.start() + i for a, b in parts for i in range(a, b)]
                    n = 0
                    for a, b in parts:  # these groups of four are the same alone
                        if n % 4 == 0:
                            inside.add(m.start() + a)
                        n += b - a
                else:
                    where = range(m.start(), m.start() + len(m.group().rstrip("=")))
                where = where[:len(where) - (len(where) % 4 == 1)]
                run = "".join(map(text.__getitem__, where)) if rule is lines else text[where[0]:where[-1] + 1]
                if (where[0], len(run), where[-1]) in tried:
                    continue
                tried.add((where[0], len(run), where[-1]))
                try:
                    data = base64.b64decode(run + "=" * (-len(run) % 4), b"-_" if k else None)
                except (binascii.Error, ValueError):
                    continue
                if _member(data) is not None:
                    whole = _Whole(place(m.start(), m.end()))
                    for block in _unfold(data, most):
                        if block is None:
                            yield None
                        else:
                            yield from _texts_of(block, whole)
                elif rule is lines or where[0] not in inside:
                    at = lambda a, b, w=where: place(w[a // 3 * 4], w[min(-(-b // 3) * 4, len(w)) - 1] + 1)
                    yield from _texts_of(data, spans if isinstance(spans, _Whole) else at)


def _inner(layer: str, spans: list[tuple[int, int]] | _Whole | None, most: int):
    """The layers that one layer yields."""
    yield from _base64_layers(layer, spans, most)
    for mark, rule, decode in (("%", _PERCENT, _percent), ("\\", _ESCAPE, _escapes)):
        if mark in layer and rule.search(layer):
            got = _in_place(layer, spans or [(i, i + 1) for i in range(len(layer))], rule, decode)
            if got and got[0]:
                yield got


def scan(text: str, most: int = MOST_BYTES) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], int, int]:
    """(base spans, all spans, layers entered, runs too large to open in one piece) of one text, spans by start, then kind."""
    order = {k: i for i, k in enumerate(KINDS)}
    by = lambda s: (s[1], order[s[0]], s[2])
    base = matches(text)
    found, seen, entered, unopened = set(base), set(), 0, 0
    work = [_inner(text, None, most)]
    while work:
        got = next(work[-1], work)
        if got is work:
            work.pop()
        elif got is None:
            unopened += 1
        else:
            layer, spans = got
            key = (hashlib.sha256(layer.encode("utf-8", "replace")).digest(), spans[0][0], spans[-1][1])
            if key in seen:
                continue
            seen.add(key)
            entered += 1
            found |= {(k, spans[a][0], spans[b - 1][1]) for k, a, b in matches(layer)}
            work.append(_inner(layer, spans, most))
    return sorted(base, key=by), sorted(found, key=by), entered, unopened


def secrets(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_layers, n_unopened.

    Counts and hash are of the base spans; ``spans`` has all, those of inner layers as the
    place of their encoded form.  Null and empty texts have none.  An empty table gives no rows.
    """
    def run(batches):
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                base, every, layers, unopened = scan(t)
                write = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
                out.append([*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(write(base).encode()).hexdigest(), write(every), layers, unopened])
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([o[k] for o in out], t) for k, t in enumerate(kinds))],
                                             ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers", "n_unopened"])

    return texts(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, n_unopened long")

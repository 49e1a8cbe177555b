"""Secrets in texts and in the encoded layers inside them."""

from __future__ import annotations

import base64
import bz2
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from functools import partial
from html import unescape
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base kinds, in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
URL = re.compile(r"(?:%[0-9A-Fa-f]{2}|%u[0-9A-Fa-f]{4})+")
#: Form-coded runs: plus signs stand for spaces.
FORM = re.compile(r"(?<![A-Za-z0-9_.~*%+-])(?:[A-Za-z0-9_.~*-]++|%[0-9A-Fa-f]{2})*+(?:\+(?:[A-Za-z0-9_.~*-]++|%[0-9A-Fa-f]{2})*+)++")
#: What percent coding leaves of bytes.
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~*+/!'()-])+")
ESCAPE = re.compile(r"""(?:\\(?:u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|U[0-9A-Fa-f]{8}|u\{[0-9A-Fa-f]{1,6}\}|[0-7]{3}|[nrtbf"'/\\]))+""")
#: What the letters of short escapes stand for.
SHORT = {"n": 10, "r": 13, "t": 9, "b": 8, "f": 12, "a": 7, "v": 11, '"': 34, "'": 39, "/": 47, "\\": 92}
#: Beginnings of compressed blocks whose bytes are written as escapes or as themselves, and one such byte.
ESCAPED_MAGIC = re.compile(r"\\x1f\\x8b(?:\\x08|\\b)|\\u001f\\u008b(?:\\u0008|\\b)|\\037\\213\\(?:010|b)|(?:x|\\x78)\\x(?:01|9c|da)|BZh[1-9](?:1AY&SY|\\x17)|(?:\(|\\x28)\\xb5(?:/|\\x2f)\\xfd", re.I)
ESCAPED_BYTE = re.compile(r"""\\(?:x([0-9A-Fa-f]{2})|u00([0-9A-Fa-f]{2})|([0-7]{1,3})|([nrtbfav"'/\\]))|([^\\\n])""")
ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Runs whose digits go on in the next lines, which may be indented or quoted.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[ \t>]*[A-Za-z0-9+/_-]++)++={0,2}")
#: Runs in short lines, of which those of one length are taken with a shorter one behind them.
NARROW = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{4,15}\r?\n[ \t>]*){2,}[A-Za-z0-9+/_-]{2,15}={0,2}")
DIGITS = re.compile(r"[A-Za-z0-9+/_-]+")
MAGIC = re.compile(rb"(?P<gzip>\x1f\x8b\x08)|(?P<zlib>\x78[\x01\x5e\x9c\xda])|(?P<bz2>BZh[1-9](?:1AY&SY|\x17rE8P\x90))|(?P<zstd>\x28\xb5\x2f\xfd)")
#: The shortest secret has 14 characters.
PRINTABLE = re.compile(rb"[\t\r\n\x20-\x7e]{14}")
UTF16 = re.compile(rb"(?:[\t\r\n\x20-\x7e]\0){14,}|(?:\0[\t\r\n\x20-\x7e]){14,}")
#: What a compressed block unpacks to is read in windows of about so many bytes. Each begins CLOSE bytes before the last one's end, or
#: where the run of CODED characters there begins, if that is at most CARRY bytes before it.
WINDOW, CARRY, CLOSE = 4 << 20, 2 << 20, 4096
PLAIN_BYTES = frozenset(b"\t\r\n" + bytes(range(0x20, 0x7F)))
CODED = bytes(c for c in range(128) if chr(c).isalnum() or chr(c) in "+/_=-%\\&#;{} \t\r\n>\0")
DECODERS = {"gzip": lambda: zlib.decompressobj(31), "zlib": zlib.decompressobj, "bz2": bz2.BZ2Decompressor, "zstd": lambda: zstandard.ZstdDecompressor().decompressobj()}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds in one layer, leftmost and non-overlapping per kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return out


class Layer:
    """A text with the original start and end of each of its characters (None: it is the original)."""

    def __init__(self, text: str, via: tuple[str, ...] = (), starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> None:
        self.text, self.via, self.starts, self.ends = text, via, starts, ends

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.starts is None else (int(self.starts[a]), int(self.ends[b - 1]))

    def inner(self, text: str, name: str, at: np.ndarray, to: np.ndarray) -> Layer:
        """A layer whose character i came from this layer's characters at[i] to to[i]."""
        if self.starts is not None:
            at, to = self.starts[at], self.ends[to - 1]
        return Layer(text, (*self.via, name), at, to)


def _replaced(layer: Layer, name: str, pattern: re.Pattern, decode) -> Layer | None:
    """The whole layer with each match decoded; decode gives (character, offset, length) within the match."""
    parts, at, to, last = [], [], [], 0
    for m in pattern.finditer(layer.text):
        keep = np.arange(last, m.start())
        parts.append(layer.text[last : m.start()])
        at.append(keep)
        to.append(keep + 1)
        chars = decode(m.group())
        parts.append("".join(c for c, _, _ in chars))
        at.append(np.array([m.start() + o for _, o, _ in chars], dtype=np.int64))
        to.append(np.array([m.start() + o + n for _, o, n in chars], dtype=np.int64))
        last = m.end()
    if not parts:
        return None
    keep = np.arange(last, len(layer.text))
    return layer.inner("".join([*parts, layer.text[last:]]), name, np.concatenate([*at, keep]), np.concatenate([*to, keep + 1]))


def _url(run: str) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    for m in re.finditer(r"%u([0-9A-Fa-f]{4})|(?:%[0-9A-Fa-f]{2})+", run):
        if m[1]:
            out.append((_char(int(m[1], 16)), m.start(), 6))
            continue
        raw, at = bytes.fromhex(m.group().replace("%", "")), m.start()
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            out += [(c, at + 3 * i, 3) for i, c in enumerate(raw.decode("latin-1"))]
            continue
        for c in text:
            n = 3 * len(c.encode())
            out.append((c, at, n))
            at += n
    return out


def _char(code: int) -> str:
    return chr(code) if code < 0xD800 or 0xE000 <= code < 0x110000 else "�"


def _escape(run: str) -> list[tuple[str, int, int]]:
    out: list[tuple[int, int, int]] = []
    for m in re.finditer(r"""\\(?:u\{([0-9A-Fa-f]+)\}|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2})|([0-7]{3})|([nrtbf"'/\\]))""", run):
        code = SHORT[m[6]] if m[6] else int(m[5], 8) if m[5] else int(m[1] or m[2] or m[3] or m[4], 16)
        if out and 0xDC00 <= code < 0xE000 and 0xD800 <= out[-1][0] < 0xDC00:
            high, at, _ = out.pop()
            out.append((0x10000 + ((high - 0xD800) << 10) + code - 0xDC00, at, m.end() - at))
        else:
            out.append((code, m.start(), m.end() - m.start()))
    return [(_char(c), a, n) for c, a, n in out]


def _form(run: str) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    for m in re.finditer(r"\+|(?:%[0-9A-Fa-f]{2})+|[^+%]+", run):
        part, at = m.group(), m.start()
        if part == "+":
            out.append((" ", at, 1))
        elif part[0] == "%":
            out += [(c, at + o, n) for c, o, n in _url(part)]
        else:
            out += [(c, at + i, 1) for i, c in enumerate(part)]
    return out


def _entity(code: str) -> list[tuple[str, int, int]]:
    return [(c, 0, len(code)) for c in unescape(code)]


def _unpacked(kind: str, stream: Callable[[], Iterator[bytes]], at: int, used: list[int]) -> Iterator[bytes]:
    """What the compressed block at a place of a stream holds, with those of its kind that follow at once; used[0]: their bytes.

    A block that breaks off gives what was read of it. Input goes in by 512 bytes, so that one step can't unpack to more
    than some 20 MB.
    """
    d, rest = None, b""
    for piece in stream():
        if at >= len(piece):
            at -= len(piece)
            continue
        for i in range(at, len(piece), 512):
            rest += piece[i : i + 512]
            while rest:
                if d is None:
                    m = MAGIC.match(rest)
                    if len(rest) < 10:
                        break  # the next piece may hold the rest of a block's head
                    if not m or m.lastgroup != kind:
                        return
                    d = DECODERS[kind]()
                try:
                    out = d.decompress(rest)
                except (zlib.error, OSError, EOFError, ValueError, zstandard.ZstdError):
                    return
                used[0] += len(rest)
                rest = b""
                if d.eof:
                    rest = d.unused_data
                    used[0] -= len(rest)
                    d = None
                if out:
                    yield out
        at = 0


def _windows(pieces: Iterator[bytes]) -> Iterator[tuple[int, bytes]]:
    """Overlapping windows of a stream, each with its place."""
    held, at = bytearray(), 0
    for piece in pieces:
        held += piece
        if len(held) >= WINDOW:
            yield at, bytes(held)
            tail = bytes(held[-CARRY:])
            keep = max(CLOSE, len(tail) - len(tail.rstrip(CODED)))
            at += len(held) - keep
            del held[:-keep]
    yield at, bytes(held)


def _contents(raw: bytes) -> Iterator[tuple[str, bytes]]:
    """Windows of what the compressed blocks in raw hold, and of what those in them hold, each with the names of the codings.

    Nothing is kept but windows: a block that doesn't end in its window is unpacked as a stream, from the blocks around it
    again. A window that was read before isn't read again, so that a block that unpacks to itself ends.
    """
    work: list[tuple[str, Callable[[], Iterator[bytes]]]] = [("", lambda: iter((raw,)))]
    seen = set()
    while work:
        name, stream = work.pop()
        end = 0
        for at, window in _windows(stream()) if name else [(0, raw)]:
            if name:
                mark = hashlib.blake2b(window, digest_size=16).digest()
                if mark in seen:
                    continue
                seen.add(mark)
                yield name, window
            for m in MAGIC.finditer(window):
                if at + m.start() < end:
                    continue
                kind, used, held, room = m.lastgroup, [0], [], WINDOW
                block = memoryview(window)[m.start() :]
                for out in _unpacked(kind, lambda block=block: iter((block,)), 0, used):
                    held.append(out)
                    room -= len(out)
                    if room < 0:
                        break
                if not held:
                    continue
                end = at + m.start() + used[0]
                if room >= 0 and used[0] < len(block) or not name and room >= 0:
                    work.append((f"{name}+{kind}", lambda held=b"".join(held): iter((held,))))
                else:
                    work.append((f"{name}+{kind}", partial(_unpacked, kind, stream, at + m.start(), [0])))


def _texts(raw: bytes) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Texts in raw with the first byte of each character and the one after: all bytes as characters, and UTF-16 runs.

    Secrets and codings are ASCII, so that other bytes only stand between them, whatever the encoding.
    """
    if PRINTABLE.search(raw):
        at = np.arange(len(raw))
        yield raw.decode("latin-1"), at, at + 1
    for m in UTF16.finditer(raw):
        at = np.arange(m.start(), m.end(), 2)
        yield m.group().replace(b"\0", b"").decode("latin-1"), at, at + 2


def _runs(text: str) -> Iterator[tuple[str, np.ndarray]]:
    """Base64 digits and their places in text: of each run, and of runs that go on over line ends."""
    for m in BASE64.finditer(text):
        yield m.group(), np.arange(m.start(), m.end())
    for m in WRAPPED.finditer(text):
        yield _lines(list(DIGITS.finditer(text, *m.span())))
    for m in NARROW.finditer(text):
        lines = list(DIGITS.finditer(text, *m.span()))
        sizes = [k.end() - k.start() for k in lines]
        i = 0
        while i < len(lines):
            j = i + 1
            while j < len(lines) and sizes[j] == sizes[i]:
                j += 1
            if j - i >= 2:
                yield _lines(lines[i : j + (j < len(lines) and sizes[j] < sizes[i])])
            i = j


def _lines(parts: list[re.Match]) -> tuple[str, np.ndarray]:
    return "".join(k.group() for k in parts), np.concatenate([np.arange(k.start(), k.end()) for k in parts])


def _deflated(raw: bytes) -> bytes:
    """What raw holds as a deflate stream without a head; empty unless it is one to its end or for a while, and reads as text."""
    d = zlib.decompressobj(-15)
    try:
        head = d.decompress(raw[:512], CLOSE)
    except zlib.error:
        return b""
    clean = sum(c in PLAIN_BYTES for c in head)
    return b"" if len(head) < 14 or clean < 0.9 * len(head) or not (d.eof or len(raw) > 512) else raw


def _raw_stream(raw: bytes) -> Iterator[bytes]:
    """The text of a deflate stream without a head, in windows; one that breaks off gives what was read."""
    d = zlib.decompressobj(-15)

    def pieces() -> Iterator[bytes]:
        for i in range(0, len(raw), 512):
            try:
                yield d.decompress(raw[i : i + 512])
            except zlib.error:
                return

    for _, window in _windows(pieces()):
        yield window


def _coded_bytes(text: str) -> Iterator[tuple[str, int, int, bytes]]:
    """(coding, start, end, bytes) of runs of percent codes or escapes that may hold compressed data."""
    if "%" in text:
        for m in PERCENT.finditer(text):
            run = m.group()
            if run.count("%") >= 3:
                for form in sorted({run, run.replace("+", "%20")}):
                    if MAGIC.search(raw := unquote_to_bytes(form)):
                        yield "url", m.start(), m.end(), raw
    if "\\" in text:
        end = 0
        for m in ESCAPED_MAGIC.finditer(text):
            if m.start() < end:
                continue
            quote = text[m.start() - 1] if m.start() and text[m.start() - 1] in "'\"" else ""
            head, _ = _escaped_bytes(text, m.start(), min(len(text), m.start() + 256), quote)
            if _begins(head):
                raw, end = _escaped_bytes(text, m.start(), len(text), quote)
                yield "escape", m.start(), end, raw


def _begins(head: bytes) -> bool:
    """Whether the first bytes of a compressed block unpack without an error."""
    if not (m := MAGIC.match(head)):
        return False
    try:
        DECODERS[m.lastgroup]().decompress(head)
    except (zlib.error, OSError, EOFError, ValueError, zstandard.ZstdError):
        return False
    return True


def _escaped_bytes(text: str, at: int, stop: int, quote: str) -> tuple[bytes, int]:
    """Bytes written as escapes or as themselves from a place on, up to the quote, a line's end or another character, and where they end."""
    out = bytearray()
    while at < stop and (m := ESCAPED_BYTE.match(text, at)):
        code = SHORT[m[4]] if m[4] else int(m[3], 8) if m[3] else int(m[1] or m[2], 16) if m[1] or m[2] else ord(m[5])
        if code > 255 or m[5] and m[5] == quote:
            break
        out.append(code)
        at = m.end()
    return bytes(out), at


def _blocks(layer: Layer) -> Iterator[Layer]:
    """Layers inside base64 runs, read from each of the four alignments: a token may follow other digits.

    Text maps byte by byte to its base64 digits, compressed text to the whole run.
    """
    for digits, place in _runs(layer.text):
        digits = digits.rstrip("=").replace("-", "+").replace("_", "/")
        first, last = place[0], place[-1] + 1
        for skip in range(4):
            run = digits[skip:]
            if len(run) % 4 == 1:
                run = run[:-1]
            raw = base64.b64decode(run + "=" * (-len(run) % 4))
            for text, at, to in _texts(raw):
                start, end = place[skip + at * 4 // 3], place[np.minimum(skip - (-to * 4 // 3), len(digits)) - 1] + 1
                yield layer.inner(text, "base64", start, end)
            for name, content in _contents(raw):
                yield from _whole(layer, "base64" + name, content, first, last)
            if not skip and _deflated(raw):
                for content in _raw_stream(raw):
                    yield from _whole(layer, "base64+deflate", content, first, last)


def _whole(layer: Layer, name: str, content: bytes, first: int, last: int) -> Iterator[Layer]:
    """The texts in what a run holds compressed, each mapped to the whole run."""
    for text, *_ in _texts(content):
        yield layer.inner(text, name, np.broadcast_to(first, len(text)), np.broadcast_to(last, len(text)))


def _inner(layer: Layer) -> Iterator[Layer]:
    """The layers one coding further in."""
    for mark, name, pattern, decode in (("%", "url", URL, _url), ("\\", "escape", ESCAPE, _escape), ("&", "entity", ENTITY, _entity)):
        if mark in layer.text and (inner := _replaced(layer, name, pattern, decode)):
            yield inner
    if "+" in layer.text and "%" in layer.text and (inner := _replaced(layer, "form", FORM, _form)):
        yield inner
    for name, first, last, raw in _coded_bytes(layer.text):
        for coding, content in _contents(raw):
            yield from _whole(layer, name + coding, content, first, last)
    yield from _blocks(layer)


def find(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, via, start, end) of all spans of a text, by start, kind and end; via is empty for the text itself.

    A worklist holds what is still to be read. Each layer is scanned, then unwrapped once for each coding it holds: percent
    codes, form coding, backslash escapes, character references, base64 (wrapped or not, in any alignment), and what is compressed
    in bytes that base64, percent codes or escapes write, with a head or, in base64, as bare deflate data.
    Layers are made one at a time. A layer text that was read before is not read again, so codings that unwrap to one
    another end. A span found in a layer is reported at the original characters it came from, unless the same span was
    found there already; different secrets of a compressed block have the block's place each.
    """
    found: list[tuple[int, int, str, str]] = []
    known: set[tuple[int, int, str, str]] = set()
    work, seen = [iter((Layer(text),))], set()
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if layer.via:
            mark = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest() + repr((layer.span(0, len(layer.text)))).encode()
            if mark in seen:
                continue
            seen.add(mark)
        for a, b, kind in base_spans(layer.text):
            span = (*layer.span(a, b), kind)
            packed = layer.starts is not None and b - a <= 256 and layer.starts[a] == layer.starts[b - 1]  # a longer one may be cut by windows
            mark = (*span, layer.text[a:b] if packed else "")
            if mark not in known:
                known.add(mark)
                found.append((*span, "/".join(layer.via)))
        work.append(_inner(layer))
    order = {k: i for i, k in enumerate(KINDS)}
    return [(kind, via, a, b) for a, b, kind, via in sorted(found, key=lambda s: (s[0], order.get(s[2], 9), s[1], s[3]))]


SPANS = "array<struct<kind:string,via:string,start:long,end:long>>"


def secret_spans(text: Column) -> Column:
    """The spans of find() for each text, in code points, end exclusive; empty for a null or clean text.

    Each row has its own result, equal ones for equal texts; an empty table gives an empty result.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("via", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf(SPANS)
    def apply(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("kind", "via", "start", "end"), s)) for s in find(t.as_py() or "")] for t in texts], kind)

    return apply(text)


def redacted_text(text: str, mark: str = "[REDACTED]") -> str:
    """text with each run of overlapping spans replaced by one mark."""
    out, last = [], 0
    for _, _, a, b in find(text):
        if a >= last:
            out += [text[last:a], mark]
        last = max(last, b)
    return "".join([*out, text[last:]]) if last else text


def redact(text: Column, mark: str = "[REDACTED]") -> Column:
    """Each text without its secrets; null stays null."""

    @F.arrow_udf("string")
    def apply(texts: pa.Array) -> pa.Array:
        return pa.array([None if (x := t.as_py()) is None else redacted_text(x, mark) for t in texts], pa.string())

    return apply(text)


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined; a span of a decoded layer has kind@via for kind."""
    kind = lambda s: F.when(s["via"] == "", s["kind"]).otherwise(F.concat_ws("@", s["kind"], s["via"]))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))))

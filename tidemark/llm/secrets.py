"""Secret scan: a worklist of decoded layers, each scanned again, with spans mapped to the original text."""

from __future__ import annotations

import base64
import codecs
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256
from urllib.parse import unquote_to_bytes

from pyspark.sql import DataFrame, SparkSession

from .common import ARROW_SPANS, SPANS, map_texts, read, span_report, unused

KINDS = ("assign", "access", "hex")
#: So many layers are named in ``via``; of deeper ones it has the number.
NAMED = 24
#: Compressed layers are read in chunks of CHUNK bytes and scanned in pieces of about PIECE; up to PIECE bytes are held.
CHUNK, PIECE = 1 << 20, 16 << 20

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

URL_TOKEN = re.compile(r"[^\s\"'<>]++")
URL_STRAY = re.compile(r"%(?![0-9A-Fa-f]{2})")
URL_ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE_ESCAPES = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|(?:\\|%)u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\U([0-9A-Fa-f]{8})")
UNICODE_RUN = re.compile(rf"(?:{UNICODE_ESCAPES.pattern})(?:[^\s\\]|{UNICODE_ESCAPES.pattern})*+".replace("([", "(?:["))
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
LINE = r"[A-Za-z0-9+/_-]++"
BREAK = r"[ \t]*+(?:\r\n?|\n)[ \t]*+"
BASE64_LINES = re.compile(rf"(?<![A-Za-z0-9+/_-]){LINE}(?:{BREAK}{LINE})++={{0,2}}")
#: White space that no rule and no encoded run reaches across.
SAFE = re.compile(r"(?<=[^\s:=\"'dtnyDTNY])\x20(?=[^\s:=])|(?<=[^\sA-Za-z0-9+/_-])[\r\n](?=\S)|[\r\n](?=[^\sA-Za-z0-9+/_-])|\n(?=\n)")
PRINTABLE = re.compile(r"[\t\n\r\x20-\x7e\u00a0-\ud7ff\ue000-\ufffc\U00010000-\U0010ffff]{6,}")
#: Where compressed bytes may begin, and ASCII text in UTF-16 of both byte orders.
ZIPPED = re.compile(rb"(?=\x1f\x8b\x08|[\x08\x18\x28\x38\x48\x58\x68\x78][\x01-\xde])", re.S)
WIDE = (re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){6,}"), re.compile(rb"(?:\x00[\t\n\r\x20-\x7e]){6,}"))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The plain rules: leftmost, not overlapping within a kind."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def readable(raw: bytes) -> Iterator[tuple[str, list[int], list[int]]]:
    """The stretches of printable text in decoded bytes, with the byte range behind each character."""
    if len(raw) < 6:
        return
    text = raw.decode("utf-8", "surrogateescape")
    ends = None
    for m in PRINTABLE.finditer(text):
        if ends is None:
            ends = [0]
            for ch in text:
                ends.append(ends[-1] + (1 if "\udc80" <= ch <= "\udcff" else len(ch.encode())))
        yield m[0], ends[m.start() : m.end()], ends[m.start() + 1 : m.end() + 1]
    if raw.count(0) > 4:
        for wide in WIDE:
            for m in wide.finditer(raw):
                yield m[0].replace(b"\0", b"").decode("ascii"), [*range(m.start(), m.end(), 2)], [*range(m.start() + 2, m.end() + 2, 2)]


def packed(raw: bytes, at: int = 0) -> bool:
    """Whether bytes from ``at`` on begin like zlib or gzip and can be inflated a little."""
    if raw[at : at + 2] != b"\x1f\x8b" and (len(raw) < at + 7 or raw[at] & 0x8F != 8 or (raw[at] << 8 | raw[at + 1]) % 31 or raw[at + 1] & 0x20):
        return False
    try:
        return bool(zlib.decompressobj(47).decompress(raw[at : at + 4096], 64)) or len(raw) - at < 64
    except zlib.error:
        return False


def deflated(raw: bytes) -> bool:
    """Whether these bytes are one whole stream of deflate without a header."""
    stream, size = zlib.decompressobj(-15), 0
    try:
        out = stream.decompress(raw, CHUNK)
        while out:
            size += len(out)
            out = b"" if stream.eof else stream.decompress(stream.unconsumed_tail, CHUNK)
    except zlib.error:
        return False
    return stream.eof and not stream.unused_data and size >= 6


def inflated(chunks: Iterable[bytes], bare: bool = False) -> Iterator[bytes]:
    """The content of all zlib or gzip members in a row (``bare``: of one without a header), and the bytes behind them; ends at the first damage."""
    stream, rest, plain, first = None, b"", False, True
    chunks = iter(chunks)
    while True:
        more = next(chunks, None)
        rest += more or b""
        while rest:
            if plain:
                yield rest
                rest = b""
                break
            if stream is None:
                if len(rest) < 7 and more is not None:
                    break
                if not (bare and first) and not packed(rest):
                    if first:
                        return
                    plain = True
                    continue
                stream, first = zlib.decompressobj(-15 if bare and first else 47), False
            try:
                out = stream.decompress(rest, CHUNK)
                while out:
                    yield out
                    out = b"" if stream.eof else stream.decompress(stream.unconsumed_tail, CHUNK)
            except zlib.error:
                return
            rest, stream = (stream.unused_data, None) if stream.eof else (b"", stream)
        if more is None:
            return


def unpack(raw: bytes, bare: bool = False) -> Iterator[tuple[str, str]]:
    """(text, name): what compressed bytes hold, also compressed bytes directly inside, in pieces of bounded size.

    Each layer is read once for its digest, so one that is equal to a layer above it ends the loop.
    """
    source: Callable[[], Iterable[bytes]] = lambda: [raw]
    seen, name = {sha256(raw).digest()}, "zip"
    while True:
        digest, size, held = sha256(), 0, []
        for c in inflated(source(), bare):
            digest.update(c)
            size += len(c)
            held = [*held, c] if size <= PIECE else []
        if not size or digest.digest() in seen:
            return
        seen.add(digest.digest())
        source = (lambda d: lambda: [d])(b"".join(held)) if size <= PIECE else (lambda s, b: lambda: inflated(s(), b))(source, bare)
        bare = False
        for piece in pieces(source()):
            yield piece, name
        name += ">zip"


def pieces(chunks: Iterable[bytes]) -> Iterator[str]:
    """The text of ``chunks``, cut at SAFE places only; what has none stays whole."""
    decoder, held, size, limit = codecs.getincrementaldecoder("utf-8")("replace"), [], 0, PIECE
    for c in chunks:
        held.append(decoder.decode(c))
        size += len(held[-1])
        if size > limit:
            text = "".join(held)
            if m := SAFE.search(text, limit // 2, len(text) - 1):
                yield text[: m.start()]
                held, limit = [text[m.start() :]], PIECE
            else:
                held, limit = [text], 2 * size
            size = len(held[0])
    yield "".join([*held, decoder.decode(b"", True)])


class Layer:
    """A decoded text; its character i stands for the original characters starts[i] to ends[i], or all for one range."""

    def __init__(self, text: str, starts: list[int] | int, ends: list[int] | int, names: tuple[str, int], above: frozenset):
        self.text, self.starts, self.ends, self.names, self.above = text, starts, ends, names, above

    @property
    def via(self) -> str:
        return self.names[0] + (f"+{self.names[1] - NAMED}" if self.names[1] > NAMED else "")

    def original(self, start: int, end: int) -> tuple[int, int]:
        return (self.starts, self.ends) if isinstance(self.starts, int) else (self.starts[start], self.ends[end - 1])


def decoded_pieces(text: str, a: int, found: re.Pattern, decode) -> tuple[str, list[int], list[int]]:
    """``text`` with each match of ``found`` decoded, and the range of ``a`` plus its positions behind each character."""
    out, starts, ends, at = [], [], [], 0
    for m in found.finditer(text):
        out.append(text[at : m.start()])
        starts += range(a + at, a + m.start())
        ends += range(a + at + 1, a + m.start() + 1)
        for ch, s, e in decode(m):
            out.append(ch)
            starts.append(a + s)
            ends.append(a + e)
        at = m.end()
    out.append(text[at:])
    starts += range(a + at, a + len(text))
    ends += range(a + at + 1, a + len(text) + 1)
    return "".join(out), starts, ends


def url_chars(m: re.Match):
    raw, at = bytes.fromhex(m[0].replace("%", "")), m.start()
    for ch in raw.decode("utf-8", "replace"):
        n = len(ch.encode()) if ch != "\ufffd" else 1
        yield ch, at, at + 3 * n
        at += 3 * n


def unicode_chars(m: re.Match):
    n = int(m[1] or m[2] or m[3] or m[4], 16)
    yield (chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else "\ufffd"), m.start(), m.end()


class Bare(bytes):
    """A stream of deflate without a header."""


def url_runs(text: str) -> Iterator[tuple[int, int]]:
    """Ranges with escapes, up to white space, quotes and signs that are no escapes; each character is looked at once."""
    for m in URL_TOKEN.finditer(text):
        if "%" in m[0]:
            at = m.start()
            for stray in (*URL_STRAY.finditer(m[0]), None):
                end = m.end() if stray is None else m.start() + stray.start()
                if text.find("%", at, end) >= 0:
                    yield at, end
                at = end + 1


def layers_of(text: str) -> list[tuple[int, int, str | bytes, list[int] | None, list[int] | None, str]]:
    """The encoded runs of ``text``: start, end, decoded text (or compressed bytes), positions behind its characters (None: the whole run), name."""
    out = []
    if "%" in text:
        for start, end in url_runs(text):
            run = text[start:end]
            out.append((start, end, *decoded_pieces(run, start, URL_ESCAPES, url_chars), "url"))
            if packed(raw := unquote_to_bytes(run)):
                out.append((start, end, raw, None, None, "url"))
    if "\\" in text or "%u" in text:
        for m in UNICODE_RUN.finditer(text):
            plain, starts, ends = decoded_pieces(m[0], m.start(), UNICODE_ESCAPES, unicode_chars)
            out.append((m.start(), m.end(), plain, starts, ends, "unicode"))
            if plain[:1] in ("\x1f", "x") and (raw := plain.encode("latin-1", "ignore")) and len(raw) == len(plain) and packed(raw):
                out.append((m.start(), m.end(), raw, None, None, "unicode"))
    runs = [(m.start(), m.end(), range(m.start(), m.end())) for m in BASE64_RUN.finditer(text)]
    if "\n" in text or "\r" in text:
        runs += [(s, e, [i for i in range(s, e) if not text[i].isspace()]) for m in BASE64_LINES.finditer(text) for s, e in wrapped(text, m.start(), m.end())]
    for start, end, places in runs:
        body = (text[start:end] if isinstance(places, range) else "".join(text[i] for i in places)).rstrip("=").replace("-", "+").replace("_", "/")
        # what stands before the code, such as a path, may shift it
        for shift in range(4):
            code = body[shift:]
            code = code[: len(code) - (len(code) % 4 == 1)]
            if len(code) < 12:
                continue
            raw = base64.b64decode(code + "=" * (-len(code) % 4))
            out += [(start, end, raw[m.start() :], None, None, "base64") for m in ZIPPED.finditer(raw) if packed(raw, m.start())]
            if deflated(raw):
                out.append((start, end, Bare(raw), None, None, "base64"))
            for plain, firsts, lasts in readable(raw):
                out.append((start, end, plain, [places[shift + 4 * i // 3] for i in firsts], [places[shift + (4 * i - 1) // 3] + 1 for i in lasts], "base64"))
    return out


def wrapped(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Ranges of lines that can be one wrapped run: lines of one width, with or without the lines before and behind."""
    lines = [(m.start(), m.end()) for m in re.compile(LINE + "=*").finditer(text, start, end)]
    i = 0
    while i < len(lines):
        j = i + 1
        while j < len(lines) and lines[j][1] - lines[j][0] == lines[i][1] - lines[i][0]:
            j += 1
        for a in {i, max(i - 1, 0)}:
            for b in {j, min(j + 1, len(lines))}:
                if b - a > 1:
                    yield lines[a][0], lines[b - 1][1]
        i = j


def scan(text: str) -> list[dict]:
    """All spans of one text: the base ones, and those of its decoded layers, in code points of ``text``."""
    spans = {k: (True, "") for k in base_spans(text)}
    places: dict[tuple[str, str], set[tuple[int, int]]] = {}

    def found_in(layer: Layer) -> None:
        for kind, s, e in base_spans(layer.text):
            place = layer.original(s, e)
            places.setdefault((kind, layer.text[s:e]), set()).add(place)
            spans.setdefault((kind, *place), (False, layer.via))

    # layers to look into, and unread rests of compressed ones; all but these are shorter than their parent, so only they can be in a cycle
    work: list = [Layer(text, 0, 0, ("", 0), frozenset())]
    # a layer that two routes reach at one place is looked into once
    seen: set = set()
    while work:
        layer = work.pop()
        if not isinstance(layer, Layer):
            pieces_left, start, end, (via, depth), above = layer
            if (found := next(pieces_left, None)) is None:
                continue
            work.append(layer)
            inner, name = found
            if not inner or (digest := sha256(inner.encode("utf-8", "surrogatepass")).digest()) in above:
                continue
            n = name.count(">") + 1
            layer = Layer(inner, start, end, (f"{via}>{name}" if depth + n <= NAMED else via, depth + n), above | {digest})
            found_in(layer)
        top = not layer.names[1]
        for start, end, inner, starts, ends, name in layers_of(layer.text):
            if not inner:
                continue
            via, depth = layer.names[0], layer.names[1] + 1
            names = (f"{via}>{name}".lstrip(">") if depth <= NAMED else via, depth)
            if starts is None or isinstance(layer.starts, int) and not top:
                starts, ends = (start, end) if top else layer.original(start, end)
            elif not top:
                starts, ends = [layer.starts[x] for x in starts], [layer.ends[x - 1] for x in ends]
            if isinstance(inner, bytes):
                work.append((unpack(inner, isinstance(inner, Bare)), starts, ends, names, layer.above))
                continue
            below = Layer(inner, starts, ends, names, layer.above)
            whole = (sha256(inner.encode("utf-8", "surrogatepass")).digest(), below.original(0, 1)[0], below.original(len(inner) - 1, len(inner))[1])
            if whole in seen:
                continue
            seen.add(whole)
            found_in(below)
            work.append(below)
    # one secret that several ways reach, such as runs with and without the line before, has the smallest of their ranges
    for (kind, _), ranges in places.items():
        least = None
        for s, e in sorted(ranges, key=lambda r: (-r[0], r[1])):
            if least is not None and e >= least:
                if not spans.get((kind, s, e), (True, ""))[0]:
                    del spans[kind, s, e]
            else:
                least = e
    order = sorted(spans, key=lambda k: (k[1], KINDS.index(k[0]), k[2]))
    return [{"kind": k, "start": s, "end": e, "base": spans[k, s, e][0], "via": spans[k, s, e][1]} for k, s, e in order]


def scan_secrets(df: DataFrame, text: str = "text", out: str = "spans", keep: list[str] | None = None) -> DataFrame:
    """Add the array ``out`` of secrets found in the whole text and in its decoded layers.

    URL escapes, Unicode escapes, base64 (also over several lines, behind other characters, and of UTF-16), zlib, gzip and (as a whole
    base64 run) bare deflate inside any of them are unwrapped until nothing new appears, whatever their depth and length; a layer that was seen at
    its place ends its branch. Spans are code points of the original text, end exclusive; what compressed bytes
    hold maps to the whole encoded run. Null and empty
    texts have no spans; equal rows give equal results; other columns pass through.
    """
    return map_texts(df, lambda texts: [scan(x) for x in texts], SPANS, ARROW_SPANS, out, text, keep)


def redact_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every secret of ``text`` replaced by ``[SECRET]``; overlapping spans count as one, null stays null."""
    import pyarrow as pa
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    def clean(x: str) -> str:
        out, at = [], 0
        for s in scan(x):
            if s["start"] >= at:
                out += [x[at : s["start"]], "[SECRET]"]
            at = max(at, s["end"])
        return "".join([*out, x[at:]]) if at else x

    out = unused("_clean", df)
    made = map_texts(df, lambda texts: [clean(x) for x in texts], T.StringType(), pa.string(), out, text)
    return made.withColumn(text, F.when(F.col(text).isNotNull(), F.col(out))).drop(out)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_report(scan_secrets(read(spark, sf_dir, "documents"), keep=["doc_id"]), KINDS)

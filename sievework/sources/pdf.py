"""What lies where on the pages of PDF files: words, ruling lines and pictures, one row each.

Read are files that are not encrypted, with plain or deflated streams, object streams, form objects, one-byte fonts and
two-byte fonts with a map to Unicode. Widths that a font does not tell count as half its size, so that ends of words are
estimates there. Coordinates are in points from the top left corner of a page, as text is read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Ref(NamedTuple):
    number: int


class Stream(NamedTuple):
    about: dict
    raw: bytes


TOKEN = re.compile(rb"(?:[\s\0]|%[^\r\n]*+)*+(<<|>>|\[|\]|\(|/[^\s()<>\[\]{}/%]*|<[0-9A-Fa-f\s]*>|[^\s\0()<>\[\]{}/%]+|[(){}<>])")
OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b")
ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|(\r\n?|\n)|(.))", re.S)
#: Letters after a backslash in a string.
ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: Forms within forms are followed so deep.
DEPTH = 8
#: Points by which a line may lean and still be a rule, and below which a filled box is one.
THIN = 3.0


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """The string whose opening bracket ends at `at`, and where it ends."""
    depth, i = 1, at
    while depth and i < len(data):
        c = data[i]
        if c == 92:
            i += 1
        elif c == 40:
            depth += 1
        elif c == 41:
            depth -= 1
        i += 1
    plain = lambda m: bytes([int(m[1], 8) & 255]) if m[1] else b"" if m[2] else ESCAPED.get(m[3], m[3])
    return ESCAPE.sub(plain, data[at : i - 1]), i


def commands(data: bytes, at: int = 0) -> Iterator[tuple[bytes, list, int]]:
    """Each keyword with what stands before it, and where it ends. Names are str, strings bytes."""
    got: list[Any] = []
    opened: list[int] = []
    while m := TOKEN.match(data, at):
        at, t = m.end(), m[1]
        if t == b"(":
            value, at = _literal(data, at)
            got.append(value)
        elif t in (b"<<", b"["):
            opened.append(len(got))
        elif t in (b">>", b"]"):
            k = opened.pop() if opened else 0
            inner = got[k:]
            got[k:] = [inner if t == b"]" else {a: b for a, b in zip(inner[::2], inner[1::2]) if isinstance(a, str)}]
        elif t[:1] == b"/":
            got.append(t[1:].decode("latin-1"))
        elif t[:1] == b"<":
            digits = b"".join(t[1:-1].split())
            got.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
        elif t == b"R" and len(got) >= 2:
            got[-2:] = [Ref(int(got[-2]))]
        elif t in (b"true", b"false", b"null"):
            got.append({b"true": True, b"false": False}.get(t))
        else:
            try:
                got.append(float(t) if b"." in t else int(t))
            except ValueError:
                if t == b"ID":  # a picture within the page; its bytes are no commands
                    end = re.compile(rb"\sEI\b").search(data, at)
                    at = end.end() if end else len(data)
                yield t, got, at
                got, opened = [], []


class File:
    """Objects of a file by number."""

    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise ValueError("not a PDF file")
        self.objects: dict[int, Any] = {}
        self.trailer: dict = {}
        end = 0
        for m in OBJECT.finditer(data):
            if m.start() < end:
                continue  # within a stream
            word, got, at = next(commands(data, m.end()), (b"", [], 0))
            value = got[-1] if got else None
            if word == b"stream" and isinstance(value, dict):
                start = at + (2 if data[at : at + 2] == b"\r\n" else 1)
                size = value.get("Length")
                end = start + size if isinstance(size, int) and data[start + size : start + size + 20].lstrip()[:9] == b"endstream" else data.find(b"endstream", start)
                end = len(data) if end < 0 else end
                value = Stream(value, data[start:end])
                if value.about.get("Type") == "XRef":
                    self.trailer |= value.about
            self.objects[int(m[1])] = value
        for m in re.finditer(rb"\btrailer\b", data):
            end = data.find(b"startxref", m.end())
            _, got, _ = next(commands(data[m.end() : end if end >= 0 else len(data)] + b"\nstartxref"), (b"", [], 0))
            self.trailer |= got[-1] if got and isinstance(got[-1], dict) else {}
        if "Encrypt" in self.trailer:
            raise ValueError("encrypted")
        for held in [o for o in self.objects.values() if isinstance(o, Stream) and o.about.get("Type") == "ObjStm"]:
            body, first = self.bytes_of(held), self.get(held.about["First"])
            numbers = [int(x) for x in body[:first].split()]
            starts = numbers[1::2]
            for number, at, end in zip(numbers[::2], starts, [*starts[1:], len(body)]):
                _, got, _ = next(commands(body[first + at : first + end] + b"\nendobj"), (b"", [], 0))
                if got:
                    self.objects.setdefault(number, got[0])

    def get(self, x: Any) -> Any:
        for _ in range(DEPTH):
            if not isinstance(x, Ref):
                break
            x = self.objects.get(x.number)
        return x

    def table(self, x: Any) -> dict:
        x = self.get(x)
        return x.about if isinstance(x, Stream) else x if isinstance(x, dict) else {}

    def filters(self, s: Stream) -> list[str]:
        f = self.get(s.about.get("Filter"))
        return [self.get(x) for x in f] if isinstance(f, list) else [f] if f else []

    def bytes_of(self, s: Any) -> bytes:
        s = self.get(s)
        if not isinstance(s, Stream):
            return b""
        data = s.raw
        for f in self.filters(s):
            if f != "FlateDecode":
                raise ValueError(f"filter {f}")
            data = zlib.decompressobj().decompress(data)
        return data

    def pages(self) -> list[tuple[dict, dict, list]]:
        """Page, resources and box of each page in order; the last two may come from the nodes above."""
        out, seen = [], set()
        todo: list[tuple[Any, dict, list]] = [(self.table(self.trailer.get("Root")).get("Pages"), {}, [0, 0, 612, 792])]
        while todo:
            at, resources, box = todo.pop()
            node = self.table(at)
            if not node or (at in seen if isinstance(at, Ref) else False):
                continue
            if isinstance(at, Ref):
                seen.add(at)
            resources = self.table(node.get("Resources")) or resources
            box = [float(self.get(x)) for x in self.get(node.get("MediaBox")) or box]
            kids = self.get(node.get("Kids"))
            if kids is None:
                out.append((node, resources, box))
            else:
                todo += [(k, resources, box) for k in reversed(kids)]
        return out

    def about(self) -> dict[str, str]:
        """Title, author and the like, as far as they are told."""
        names = {"Title": "title", "Author": "author", "Subject": "subject", "Creator": "creator", "Producer": "producer", "CreationDate": "creation_date", "ModDate": "modification_date"}
        told = {k: self.get(v) for k, v in self.table(self.trailer.get("Info")).items()}
        return {name: v.decode("utf-16") if v[:2] in (b"\xfe\xff", b"\xff\xfe") else v.decode("latin-1") for key, name in names.items() if isinstance(v := told.get(key), bytes)}


class Font:
    def __init__(self, file: File, about: dict):
        self.wide = file.get(about.get("Subtype")) == "Type0"
        self.first = file.get(about.get("FirstChar")) or 0
        self.widths = [file.get(w) for w in file.get(about.get("Widths")) or []]
        self.other = 600 if "Courier" in str(file.get(about.get("BaseFont"))) else 500
        self.said: dict[int, str] = {}
        for word, got, _ in commands(file.bytes_of(about["ToUnicode"])) if "ToUnicode" in about else ():
            if word == b"endbfchar":
                self.said |= {int.from_bytes(a): b.decode("utf-16-be", "replace") for a, b in zip(got[::2], got[1::2])}
            elif word == b"endbfrange":
                for a, b, to in zip(got[::3], got[1::3], got[2::3]):
                    for i in range(int.from_bytes(b) - int.from_bytes(a) + 1):
                        text = to[i] if isinstance(to, list) else to[:-2] + struct.pack(">H", (int.from_bytes(to[-2:]) + i) & 0xFFFF)
                        self.said[int.from_bytes(a) + i] = text.decode("utf-16-be", "replace")

    def letters(self, data: bytes) -> Iterator[tuple[str, float, bool]]:
        """Each letter, its width for size 1, and whether it is the one-byte space."""
        step = 2 if self.wide else 1
        for i in range(0, len(data) - step + 1, step):
            code = int.from_bytes(data[i : i + step])
            k = code - self.first
            width = self.widths[k] if 0 <= k < len(self.widths) else self.other
            yield self.said.get(code) or (chr(code) if self.wide else bytes([code]).decode("cp1252", "replace")), width / 1000, not self.wide and code == 32


def _times(a: tuple, b: tuple) -> tuple:
    """First a, then b."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


ONE = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


class Page:
    """Words, rules and places of pictures of one page, in the order in which it draws them; y runs up here."""

    def __init__(self, file: File, resources: dict):
        self.file = file
        self.words: list[list] = []
        self.rules: list[tuple] = []
        self.placed: dict[Any, tuple] = {}
        self.fonts: dict[int, Font] = {}
        self.glue = True

    def say(self, font: Font, data: bytes, size: float, gaps: tuple, matrix: tuple, base: tuple) -> tuple:
        for letter, width, space in font.letters(data):
            at = _times(matrix, base)
            step = width * size + gaps[0] + gaps[1] * space
            scale = abs(at[0]) or abs(at[1]) or 1.0
            if letter.isspace():
                self.glue = False
            else:
                x, y, high = at[4], at[5], abs(size) * (abs(at[3]) or scale)
                end = x + width * size * scale
                last = self.words[-1] if self.words else None
                if self.glue and last and abs(last[1] - y) < 0.1 * high and -0.5 * high < x - last[2] < 0.15 * high:
                    last[2], last[4] = end, last[4] + letter
                else:
                    self.words.append([x, y, end, y + high, letter])
                self.glue = True
            matrix = _times((1, 0, 0, 1, step, 0), matrix)
        return matrix

    def draw(self, data: bytes, resources: dict, base: tuple = ONE, depth: int = 0) -> None:
        kept: list[tuple] = []
        matrix = line = ONE
        font, size, gaps, leading = None, 1.0, (0.0, 0.0), 0.0
        path: list[tuple] = []
        at = start = (0.0, 0.0)
        for word, x, _ in commands(data):
            if word == b"q":
                kept.append((base, font, size, gaps, leading))
            elif word == b"Q" and kept:
                base, font, size, gaps, leading = kept.pop()
            elif word == b"cm" and len(x) >= 6:
                base = _times(tuple(x[-6:]), base)
            elif word == b"BT":
                matrix, self.glue = ONE, False
                line = matrix
            elif word == b"Tf" and len(x) >= 2:
                about = self.file.table(self.file.table(resources.get("Font")).get(x[-2]))
                if id(about) not in self.fonts or not about:
                    self.fonts[id(about)] = Font(self.file, about)
                font, size = self.fonts[id(about)], x[-1]
            elif word == b"Tc":
                gaps = (x[-1], gaps[1])
            elif word == b"Tw":
                gaps = (gaps[0], x[-1])
            elif word == b"TL":
                leading = x[-1]
            elif word == b"Tm" and len(x) >= 6:
                matrix = line = tuple(x[-6:])
                self.glue = False
            elif word in (b"Td", b"TD") and len(x) >= 2:
                leading = -x[-1] if word == b"TD" else leading
                matrix = line = _times((1, 0, 0, 1, x[-2], x[-1]), line)
            elif word in (b"T*", b"'", b'"'):
                gaps = (x[1], x[0]) if word == b'"' and len(x) >= 3 else gaps
                matrix = line = _times((1, 0, 0, 1, 0, -leading), line)
            if word in (b"Tj", b"TJ", b"'", b'"') and x and font:
                for part in x[-1] if isinstance(x[-1], list) else [x[-1]]:
                    if isinstance(part, bytes):
                        matrix = self.say(font, part, size, gaps, matrix, base)
                    elif isinstance(part, (int, float)):
                        self.glue = self.glue and part > -200
                        matrix = _times((1, 0, 0, 1, -part / 1000 * size, 0), matrix)
            elif word == b"m" and len(x) >= 2:
                at = start = (x[-2], x[-1])
            elif word == b"l" and len(x) >= 2:
                path.append((*at, x[-2], x[-1]))
                at = (x[-2], x[-1])
            elif word == b"h":
                path.append((*at, *start))
                at = start
            elif word == b"re" and len(x) >= 4:
                a, b, w, h = x[-4:]
                path.append((a, b, a + w, b + h, "box"))
            elif word in (b"S", b"s", b"B", b"B*", b"b", b"b*", b"f", b"F", b"f*", b"n"):
                if word != b"n":
                    self.rule(path, base, filled=word in (b"f", b"F", b"f*"))
                path = []
            elif word == b"Do" and x:
                ref = self.file.table(resources.get("XObject")).get(x[-1])
                held = self.file.get(ref)
                if isinstance(held, Stream) and held.about.get("Subtype") == "Image":
                    corners = [_times((1, 0, 0, 1, a, b), base)[4:] for a in (0, 1) for b in (0, 1)]
                    xs, ys = zip(*corners)
                    self.placed.setdefault(x[-1], (min(xs), min(ys), max(xs), max(ys)))
                elif isinstance(held, Stream) and depth < DEPTH:
                    inner = tuple(self.file.get(held.about.get("Matrix")) or ONE)
                    self.draw(self.file.bytes_of(held), self.file.table(held.about.get("Resources")) or resources, _times(inner, base), depth + 1)

    def rule(self, path: list[tuple], base: tuple, filled: bool) -> None:
        for a, b, c, d, *box in path:
            (x0, y0), (x1, y1) = _times((1, 0, 0, 1, a, b), base)[4:], _times((1, 0, 0, 1, c, d), base)[4:]
            x0, x1, y0, y1 = min(x0, x1), max(x0, x1), min(y0, y1), max(y0, y1)
            if x1 - x0 < THIN or y1 - y0 < THIN:
                self.rules.append((x0, y0, x1, y1))
            elif box and not filled:
                self.rules += [(x0, y0, x1, y0), (x0, y1, x1, y1), (x0, y0, x0, y1), (x1, y0, x1, y1)]


def _png(width: int, height: int, colours: int, packed: bytes) -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if colours == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", packed) + chunk(b"IEND", b"")


def picture(file: File, held: Stream) -> tuple[bytes, str]:
    """Bytes and suffix: JPEG and JPEG 2000 as they are, grey and colour of eight bits as PNG, else the raw samples."""
    used, about = file.filters(held), held.about
    if used and used[-1] in ("DCTDecode", "JPXDecode"):
        data = held.raw if len(used) == 1 else file.bytes_of(Stream(about | {"Filter": used[:-1]}, held.raw))
        return data, "jpg" if used[-1] == "DCTDecode" else "jp2"
    colours = {"DeviceRGB": 3, "DeviceGray": 1}.get(str(file.get(about.get("ColorSpace"))))
    width, height = file.get(about["Width"]), file.get(about["Height"])
    if not colours or file.get(about.get("BitsPerComponent")) != 8:
        return held.raw, "bin"
    if file.table(about.get("DecodeParms")).get("Predictor", 1) >= 10:
        return _png(width, height, colours, held.raw), "png"
    data, row = file.bytes_of(held), width * colours
    return _png(width, height, colours, zlib.compress(b"".join(b"\0" + data[i * row : (i + 1) * row] for i in range(height)))), "png"


def contents(file: File, page: dict) -> bytes:
    body = file.get(page.get("Contents"))
    return b"\n".join(file.bytes_of(x) for x in (body if isinstance(body, list) else [body]))


def marks_of(data: bytes) -> Iterator[tuple]:
    """(page, kind, place in the page, x0, y0, x1, y1, text, content, extension, width, height) of a file; a picture of a
    page's resources that is not drawn has no place on it."""
    file = File(data)
    for number, (node, resources, box) in enumerate(file.pages(), 1):
        page = Page(file, resources)
        page.draw(contents(file, node), resources)
        left, top = box[0], box[3]
        flat = lambda r: (r[0] - left, top - r[3], r[2] - left, top - r[1])
        for i, w in enumerate(page.words):
            yield number, "word", i, *flat(w), w[4], None, None, None, None
        for i, r in enumerate(page.rules):
            yield number, "rule", i, *flat(r), None, None, None, None, None
        held = [(name, file.get(ref)) for name, ref in file.table(resources.get("XObject")).items()]
        for i, (name, s) in enumerate(p for p in held if isinstance(p[1], Stream) and p[1].about.get("Subtype") == "Image"):
            place = [round(v, 2) for v in flat(page.placed[name])] if name in page.placed else [None] * 4
            data, suffix = picture(file, s)
            yield number, "image", i, *place, None, data, suffix, file.get(s.about.get("Width")), file.get(s.about.get("Height"))


def text_of(data: bytes) -> list[str]:
    """Text of each page: its words in the order of drawing, a new line where the baseline moves."""
    file, out = File(data), []
    for node, resources, _ in file.pages():
        page = Page(file, resources)
        page.draw(contents(file, node), resources)
        said, y = [], None
        for w in page.words:
            said.append(("" if y is None else " " if abs(w[1] - y) < 0.5 * (w[3] - w[1]) else "\n") + w[4])
            y = w[1]
        out.append("".join(said))
    return out


MARKS = "path string, page int, kind string, place int, x0 double, y0 double, x1 double, y1 double, text string, content binary, extension string, width int, height int"


def marks(found: DataFrame, kinds: tuple[str, ...] = ("word", "rule", "image")) -> DataFrame:
    """What lies on the pages of the PDF files of found (path, content), a row for each mark. Files that cannot be read
    and rows without content have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in MARKS.split(", ")]
        for frame in frames:
            for path, content in frame.itertuples(index=False):
                try:
                    out = [(path, *m) for m in marks_of(content) if m[1] in kinds]
                except Exception:  # noqa: BLE001  one bad file must not end the scan
                    out = []
                yield pd.DataFrame(out, columns=names).astype({"page": "int32", "place": "int32", "width": "Int32", "height": "Int32", **dict.fromkeys(("x0", "y0", "x1", "y1"), "float64")})

    rows = found.where(F.lower("path").endswith(".pdf") & F.col("content").isNotNull()).select("path", "content")
    return rows.mapInPandas(run, MARKS)

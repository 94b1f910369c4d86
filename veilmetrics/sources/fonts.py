"""Fonts of PDF files: objects and resources, the catalogue of code maps and widths, decoded runs, occurrences, an inventory.

A font's code map is the first that there is: ToUnicode, an encoding dictionary with its Differences, a named encoding, the
default encoding. Its widths are the file's own (Widths, or W of a descendant in both forms), else those of a core font.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.widths import COURIER, HELVETICA
from . import pdf

# Names of glyphs that no rule gives, and their characters.
GLYPHS = {
    "space": " ", "nbspace": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "quoteright": "’", "quoteleft": "’",
    "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "sfthyphen": "-", "period": ".", "slash": "/", "colon": ":", "semicolon": ";", "less": "<",
    "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "circumflex": "^", "underscore": "_", "grave": "`",
    "braceleft": "{", "bar": "|", "brokenbar": "|", "braceright": "}", "asciitilde": "~", "tilde": "~", "endash": "–", "emdash": "—", "quotedblleft": '"', "quotedblright": '"', "quotedblbase": '"',
    "quotesinglbase": "'", "guillemotleft": "<", "guilsinglleft": "<", "guillemotright": ">", "guilsinglright": ">", "bullet": "•", "dagger": "†", "daggerdbl": "‡", "ellipsis": "…", "trademark": "™",
    "Euro": "€", "copyright": "©", "registered": "®", "paragraph": "¶", "periodcentered": "·", "plusminus": "±", "divide": "÷", "multiply": "×", "logicalnot": "¬", "sterling": "£", "yen": "¥",
    "currency": "¤", "section": "§", "cent": "¢", "degree": "°", "florin": "ƒ", "mu": "µ", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "lslash": "ł", "Lslash": "Ł", "oslash": "ø", "Oslash": "Ø",
    "germandbls": "ß", "dotlessi": "ı", "ntilde": "ń", "nacute": "ń", "Nacute": "Ñ",
}
ACCENTS = {"acute": "\u0301", "grave": "\u0300", "circumflex": "\u0302", "dieresis": "\u0308", "tilde": "\u0303", "ring": "\u030a", "cedilla": "\u0327"}
CORE = ("Courier", "Helvetica", "Helvetica-Bold", "Times-Roman")
DIGITS = "zero one two three four five six seven eight nine".split()


def glyph_char(name: str) -> str | None:
    """The character of a glyph name: a listed one, a letter with an accent, or a name of one character."""
    if name in GLYPHS:
        return GLYPHS[name]
    if len(name) > 1 and name[1:] in ACCENTS and name[0].isalpha():
        c = unicodedata.normalize("NFC", name[0] + ACCENTS[name[1:]])
        return c if len(c) == 1 else None
    return name if len(name) == 1 else None


class Ref(int):
    """The number of an indirect object."""


class Name(str):
    pass


_TOKEN = re.compile(rb"\s+|%[^\r\n]*|<<|>>|\[|\]|/[^\s/<>\[\]()%]*|\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|(\d+)\s+(\d+)\s+R\b|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)


def parse(body: bytes) -> Any:
    """The first value in an object's body: dictionaries, lists, names, references, numbers, strings, words."""
    stack: list[list] = [[]]
    for m in _TOKEN.finditer(body):
        t = m[0]
        if t[:1].isspace() or t[:1] == b"%":
            continue
        if t in (b"<<", b"["):
            stack.append([])
            continue
        if t in (b">>", b"]"):
            if len(stack) == 1:
                break
            done = stack.pop()
            value: Any = dict(zip(done[::2], done[1::2])) if t == b">>" else done
        elif t[:1] == b"/":
            value = Name((re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), t[1:]) if b"#" in t else t[1:]).decode("latin-1"))
        elif m[1]:
            value = Ref(int(m[1]))
        elif t[:1] == b"(":
            value = unescape(t[1:-1])
        elif t[:1] == b"<":
            h = re.sub(rb"\s", b"", t[1:-1])
            value = bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
        elif t[:1].isdigit() or t[:1] in b"+-.":
            value = float(t) if b"." in t else int(t)
        else:
            value = t.decode("latin-1")
        stack[-1].append(value)
        if len(stack) == 1:
            return value
    return None


def unescape(s: bytes) -> bytes:
    """A literal string's bytes: octal codes, named escapes, joined lines."""
    named = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b""}
    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1] in b"01234567" else b"" if m[1] == b"\r\n" else named.get(m[1], m[1]), s, flags=re.S)


class File:
    """A PDF's objects, read when they are asked for."""

    def __init__(self, data: bytes):
        if not data.startswith(b"%PDF"):
            raise ValueError("not a PDF")
        self.bodies = pdf.objects(data)
        self.known: dict[int, Any] = {}
        self.fonts: dict[int, dict] = {}
        self.steps: dict[bytes, list] = {}

    def get(self, value: Any) -> Any:
        """The value itself, behind references."""
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            if value not in self.known:
                self.known[value] = parse(self.bodies.get(value, b""))
            value = self.known[value]
        return None

    def stream(self, ref: Any) -> bytes:
        return pdf.stream(self.bodies.get(ref, b"")) if isinstance(ref, Ref) else b""

    def pages(self) -> list[dict]:
        out = [self.get(Ref(i)) for i, b in self.bodies.items() if re.search(rb"/Type\s*/Page\b(?!s)", b)]
        return [p for p in out if isinstance(p, dict)]

    def inherited(self, page: dict, key: str) -> Any:
        for _ in range(pdf.MAX_PARENTS):
            if key in page:
                return self.get(page[key])
            page = self.get(page.get("Parent"))
            if not isinstance(page, dict):
                return None
        return None

    def operations(self, content: bytes) -> list:
        """pdf.operations, worked out once for all that look at them."""
        if content not in self.steps:
            self.steps[content] = list(pdf.operations(content))
        return self.steps[content]

    def content(self, page: dict) -> bytes:
        c = page.get("Contents")
        refs = c if isinstance(c, list) else self.get(c) if isinstance(self.get(c), list) else [c]
        return b"\n".join(self.stream(r) for r in refs)


def _cmap(data: bytes) -> dict[int, str]:
    """Codes and their texts, of bfchar and bfrange."""
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out: dict[int, str] = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[int(a, 16)] = text(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for a, z, one, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])", block):
            given = [text(x) for x in re.findall(rb"<([0-9A-Fa-f]+)>", many)]
            for k, code in enumerate(range(int(a, 16), min(int(z, 16), int(a, 16) + 65535) + 1)):
                if many:
                    if k < len(given):
                        out[code] = given[k]
                else:
                    first = text(one)
                    out[code] = first[:-1] + chr(ord(first[-1]) + k)
    return out


def one_byte(encoding: str | None) -> dict[int, str]:
    """The characters of a named encoding; the standard one if the name isn't known."""
    return dict(_one_byte(str(encoding)))


@cache
def _one_byte(encoding: str) -> dict[int, str]:
    if encoding in ("WinAnsiEncoding", "MacRomanEncoding"):
        codec = "cp1252" if encoding == "WinAnsiEncoding" else "mac_roman"
        return {i: c for i in range(32, 256) if (c := bytes([i]).decode(codec, "ignore")) and c.isprintable()}
    return {i: chr(i) for i in range(32, 127)} | {39: "’", 96: "‘"}


def font_truth(f: File, font: dict) -> dict:
    """What is known of a font: names, sources, chars (code -> text), widths (code -> units), bytes a code."""
    kind, base = font.get("Subtype"), str(font.get("BaseFont", ""))
    enc, widths, two = f.get(font.get("Encoding")), {}, kind == "Type0"
    if two:
        child = f.get((f.get(font.get("DescendantFonts")) or [None])[0]) or {}
        w, i = f.get(child.get("W")) or [], 0
        while i < len(w):
            nxt = f.get(w[i + 1]) if i + 1 < len(w) else None
            if isinstance(nxt, list):  # first [w w w]
                widths |= {int(w[i]) + k: x for k, x in enumerate(nxt)}
                i += 2
            elif i + 2 < len(w):  # first last w
                widths |= dict.fromkeys(range(int(w[i]), min(int(w[i + 1]), int(w[i]) + 65535) + 1), w[i + 2])
                i += 3
            else:
                break
        described = f.get(child.get("FontDescriptor")) or {}
    else:
        widths = {int(font.get("FirstChar", 0)) + k: x for k, x in enumerate(f.get(font.get("Widths")) or [])}
        described = f.get(font.get("FontDescriptor")) or {}
    chars, source = {}, "none"
    if isinstance(font.get("ToUnicode"), Ref):
        chars, source = {c: t for c, t in _cmap(f.stream(font["ToUnicode"])).items() if len(t) == 1}, "to_unicode"
    if not chars and isinstance(enc, dict):
        chars, source, code = one_byte(f.get(enc.get("BaseEncoding"))), "encoding_dictionary", None
        for x in f.get(enc.get("Differences")) or []:
            if isinstance(x, Name):
                if code is not None:
                    chars.pop(code, None)
                    if c := glyph_char(x):
                        chars[code] = c
                    code += 1
            elif isinstance(x, int) and 0 <= x <= 65535:
                code = x
    if not chars and isinstance(enc, Name) and not two:
        chars, source = one_byte(enc), "named_encoding"
    if not chars and not two:
        chars, source = one_byte(None), "standard_default_encoding"
    name = re.sub(r"^[A-Z]{6}\+([^+]+)$", r"\1", base)
    if not widths and name in ("Courier", "Helvetica"):
        table = COURIER if name == "Courier" else HELVETICA
        widths, width_source = {c: table[ord(t) - 32] for c, t in chars.items() if 32 <= ord(t) < 127}, "standard_14"
    else:
        width_source = "explicit" if widths else "none"
    return {"subtype": kind or "", "base_font": base, "name": name, "unicode_source": source if chars else "none", "width_source": width_source, "chars": chars, "widths": widths, "code_bytes": 2 if two else 1,
        "embedded": any(k.startswith("FontFile") for k in described), "has_widths": width_source == "explicit", "to_unicode": "ToUnicode" in font, "differences": isinstance(enc, dict) and "Differences" in enc, "named": isinstance(enc, Name)}


def page_fonts(f: File, resources: Any) -> dict[str, dict]:
    of = f.get((f.get(resources) or {}).get("Font")) or {}
    return {k: _truth(f, v, d) for k, v in of.items() if isinstance(d := f.get(v), dict)}


def _truth(f: File, of: Any, font: dict) -> dict:
    """font_truth, worked out once for a font that several resources name."""
    if not isinstance(of, Ref):
        return font_truth(f, font)
    if of not in f.fonts:
        f.fonts[of] = font_truth(f, font)
    return f.fonts[of]


def _forms(f: File, resources: Any, seen: frozenset):
    """Form XObjects by name; one that was visited on this page is not visited again."""
    of = f.get((f.get(resources) or {}).get("XObject")) or {}
    return {k: (v, d) for k, v in of.items() if k not in seen and isinstance(d := f.get(v), dict) and d.get("Subtype") == "Form"}


def shown(f: File, content: bytes, resources: Any, seen: frozenset = frozenset()) -> list[tuple]:
    """(text, x0, y0, x1, y1, font key, font name, size) of each shown string, in forms too: codes by the font's map, widths by its table.

    A code's width is scaled by size and Tz; Tc is added between characters and Tw at spaces, as are the adjustments of TJ.
    """
    fonts, out = page_fonts(f, resources), []
    key, size, lead, tz, tc, tw, x, y, lx, ly = "", 12.0, 0.0, 100.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0
    visited = set(seen)

    def show(parts):
        nonlocal x
        font = fonts.get(key)
        step = font["code_bytes"] if font else 1
        text, w, begun = "", 0.0, False
        for p in parts:
            if isinstance(p, float):
                w += -p / 1000 * size * tz / 100 if begun else 0.0
                continue
            data = p.encode("latin-1")
            for i in range(0, len(data) - step + 1, step):
                code = int.from_bytes(data[i : i + step], "big")
                c = font["chars"].get(code) if font else chr(code)
                if c is None:
                    continue
                units = font["widths"].get(code, 600) if font else 600
                w += units * size / 1000 * max(tz / 100, 0.01) + (tc if begun else 0.0) + (tw if c == " " else 0.0)
                text, begun = text + c, True
        if text:
            out.append((text, x, y - size, x + max(w, 0.001), y, key, font["name"] if font else "", size))
        x += w

    for op, a in f.operations(content):
        n = [v for v in a if isinstance(v, float)]
        if op == "BT":
            x = y = lx = ly = 0.0
        elif op == "Tf" and len(a) >= 2:
            key, size = str(a[0]), float(a[1])
        elif op == "Tz" and n:
            tz = n[0]
        elif op == "Tc" and n:
            tc = n[0]
        elif op == "Tw" and n:
            tw = n[0]
        elif op == "TL" and n:
            lead = n[0]
        elif op == "Tm" and len(n) >= 6:
            x = lx = n[4]
            y = ly = n[5]
        elif op in ("Td", "TD") and len(n) >= 2:
            lx, ly = lx + n[0], ly + n[1]
            x, y = lx, ly
            lead = -n[1] if op == "TD" else lead
        elif op in ("T*", "'", '"'):
            ly += pdf.newline_delta(lead, size)
            x, y = lx, ly
            if op != "T*" and a:
                show([a[-1]])
        elif op == "Tj" and a and isinstance(a[0], str):
            show([a[0]])
        elif op == "TJ" and a and isinstance(a[0], list):
            show(a[0])
        elif op == "Do" and a and (form := _forms(f, resources, frozenset(visited)).get(str(a[0]))):
            visited.add(str(a[0]))
            out += shown(f, f.stream(form[0]), form[1].get("Resources", resources), frozenset(visited))
    return out


def path_rect(points: list[tuple[float, float]], closed: bool) -> tuple | None:
    """The rectangle of a closed path of four points or more that hits three corners of its bounds, to a hundredth of a point."""
    if not closed or len(points) < 4:
        return None
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    x0, x1, y0, y1 = min(xs), max(xs), min(ys), max(ys)
    if x1 <= x0 or y1 <= y0:
        return None
    at = lambda p: (round(p[0] * 100), round(p[1] * 100))
    hit = {at(p) for p in points} & {at((x, y)) for x in (x0, x1) for y in (y0, y1)}
    return (x0, y0, x1, y1) if len(hit) >= 3 else None


def drawn(f: File, content: bytes, resources: Any, seen: frozenset = frozenset()) -> list[tuple]:
    """(kind, x0, y0, x1, y1): black rectangles, rectangles of closed black paths, and those of forms."""
    out, fill, saved, points, closed, visited = [], (0.0, 0.0, 0.0), [], [], False, set(seen)
    for op, a in f.operations(content):
        n = [v for v in a if isinstance(v, float)]
        if op == "q":
            saved.append(fill)
        elif op == "Q" and saved:
            fill = saved.pop()
        elif op in ("g", "rg", "k", "sc", "scn") and n:
            fill = pdf.rgb(n)
        elif op == "re" and len(n) == 4 and max(fill) <= 0.01:
            x, y, w, h = n
            out.append(("drawn_rect", min(x, x + w), min(y, y + h), max(x, x + w), max(y, y + h)))
        elif op == "m" and len(n) >= 2:
            points, closed = [(n[0], n[1])], False
        elif op == "l" and len(n) >= 2:
            points.append((n[0], n[1]))
        elif op == "h":
            closed = True
        elif op in ("f", "F", "f*", "B", "B*", "b", "b*"):
            if op in ("b", "b*"):
                closed = True
            if max(fill) <= 0.01 and (r := path_rect(points, closed)):
                out.append(("drawn_path_rect", *r))
            points, closed = [], False
        elif op in ("n", "S", "s"):
            points, closed = [], False
        elif op == "Do" and a and (form := _forms(f, resources, frozenset(visited)).get(str(a[0]))):
            visited.add(str(a[0]))
            out += drawn(f, f.stream(form[0]), form[1].get("Resources", resources), frozenset(visited))
    return out


def annotations(f: File, page: dict) -> list[tuple]:
    """(subtype, rt, it, ft, nm, contents, x0, y0, x1, y1) of a page's annotations that have a rectangle."""
    text = lambda v: v.decode("utf-16") if isinstance(v, bytes) and v[:2] in (b"\xfe\xff", b"\xff\xfe") else v.decode("latin-1") if isinstance(v, bytes) else None if v is None else str(v)
    out = []
    for a in f.get(page.get("Annots")) or []:
        a = f.get(a)
        r = f.get(a.get("Rect")) if isinstance(a, dict) else None
        if isinstance(r, list) and len(r) == 4:
            x0, y0, x1, y1 = map(float, r)
            out.append((*(text(f.get(a.get(k))) for k in ("Subtype", "RT", "IT", "FT", "NM", "Contents")), min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)))
    return out


def _pages(data: bytes):
    f = File(data)
    for i, p in enumerate(f.pages()):
        yield i, f, f.content(p), f.inherited(p, "Resources")


SHOWN = "path string, page_index int, seq int, text string, x0 double, y0 double, x1 double, y1 double, font_key string, font_name string, font_size double, error string"
DRAWN = "path string, page_index int, seq int, kind string, x0 double, y0 double, x1 double, y1 double, error string"
TRUTH = "path string, page_index int, font_key string, subtype string, base_font string, name string, unicode_source string, width_source string, codes map<int,string>, widths map<int,double>, embedded boolean, has_widths boolean, to_unicode boolean, differences boolean, named boolean, error string"

NOTES = "path string, page_index int, seq int, subtype string, rt string, it string, ft string, nm string, contents string, x0 double, y0 double, x1 double, y1 double, error string"


def _notes(data: bytes) -> list[tuple]:
    f = File(data)
    return [(i, k, *r) for i, p in enumerate(f.pages()) for k, r in enumerate(annotations(f, p))]


read_annotations = pdf._reader(NOTES, _notes)
read_shown = pdf._reader(SHOWN, lambda d: [(i, k, *r) for i, f, c, res in _pages(d) for k, r in enumerate(shown(f, c, res))])
read_drawn = pdf._reader(DRAWN, lambda d: [(i, k, *r) for i, f, c, res in _pages(d) for k, r in enumerate(drawn(f, c, res))])
read_truth = pdf._reader(TRUTH, lambda d: [(i, k, t["subtype"], t["base_font"], t["name"], t["unicode_source"], t["width_source"], t["chars"], {c: float(w) for c, w in t["widths"].items()}, t["embedded"], t["has_widths"], t["to_unicode"], t["differences"], t["named"])
    for i, f, _, res in _pages(d) for k, t in page_fonts(f, res).items()])


def subset_base(name: Column) -> Column:
    """A font's name without the prefix of a subset."""
    return F.regexp_replace(name, r"^[A-Z]{6}\+([^+]+)$", "$1")


def family_variant(name: Column) -> tuple[Column, Column]:
    """Family and variant of a name with exactly one hyphen; else the name and null."""
    two = F.size(F.split(name, "-")) == 2
    return F.when(two, F.split_part(name, F.lit("-"), F.lit(1))).otherwise(name), F.when(two, F.split_part(name, F.lit("-"), F.lit(2)))


def input_kind(path: Column) -> Column:
    """By the extension: pdf, html, image or unknown."""
    ext = F.lower(F.regexp_extract(path, "[.]([A-Za-z0-9]+)$", 1))
    return F.when(ext == "pdf", "pdf").when(ext.isin("html", "htm"), "html").when(ext.isin("png", "jpg", "jpeg"), "image").otherwise("unknown")


def fold_quotes(text: Column) -> Column:
    return F.translate(text, "‰‹«›»", "<<<>>")


def occurrences(runs):
    """Where each font occurs: boxes three sizes wide, with family and variant."""
    family, variant = family_variant(F.col("font_name"))
    return runs.where("text is not null").select("path", "page_index", "seq", family.alias("family"), variant.alias("variant"), "text", "x0", "y0", (F.col("x0") + 3 * F.col("font_size")).alias("x1"), "y1")


def inventory(truth):
    """The catalogue with the source of each font's widths and of its characters."""
    width = F.when(F.col("embedded"), "embedded_font_program").when(F.col("has_widths"), "pdf_width_table").when(F.col("name").isin(*CORE), "standard_14_font").otherwise("none")
    chars = F.when(F.col("to_unicode"), "to_unicode").when(F.col("differences"), "encoding_differences").when(F.col("named"), "named_encoding").otherwise("none")
    return truth.withColumns({"width_class": width, "unicode_class": chars})


def make_pdf(lines: list[str], first: str, at: int) -> bytes:
    """A page with three fonts and a form, for checks with known text.

    F1 shows `first` by a Differences encoding with explicit widths; F2 shows the lines by codes that only its ToUnicode map
    explains; the form draws a rectangle, the page a closed path; both are placed by `at`.
    """
    chars = sorted({c for x in lines for c in x})[:254]
    code = {c: i + 1 for i, c in enumerate(chars)}
    hexed = lambda b: "<" + bytes(b).hex() + ">"
    known = {v: k for k, v in reversed(GLYPHS.items())}
    letters = sorted(set(first))
    names = [known.get(c, c) for c in letters]
    own = {c: 130 + i for i, c in enumerate(letters)}
    body = f"0 g {72 + at % 100} 50 m {172 + at % 100} 50 l {172 + at % 100} 70 l {72 + at % 100} 70 l h f\n/X1 Do\n"
    body += f"BT /F1 12 Tf 72 740 Td {hexed(own[c] for c in first)} Tj ET\n"
    body += "BT /F2 10 Tf 14 TL 72 720 Td " + "".join(f"{hexed(code[c] for c in x if c in code)} Tj T* " for x in lines) + "ET"
    cmap = "begincmap 1 begincodespacerange <00> <ff> endcodespacerange\n" + "".join(f"1 beginbfchar <{i:02x}> <{c.encode('utf-16-be').hex()}> endbfchar\n" for c, i in code.items()) + "endcmap"
    form = f"0 0 0 rg 300 {100 + at % 50} 60 12 re f"
    objs = [
        "<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 612 792] /Resources 4 0 R >>", f"<< /Type /Page /Parent 2 0 R /Contents 5 0 R /Annots [<< /Subtype /Redact /Rect [72 200 90 212] >> << /Subtype /Square /Contents ({'Black' if at % 3 == 0 else 'white'}out) /Rect [100 212 82 200] >> << /Subtype /Text /Contents (a note) /Rect [1 2 3 4] >>] >>",
        "<< /Font << /F1 6 0 R /F2 7 0 R /F3 << /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >> >> /XObject << /X1 9 0 R >> >>", (body, ""),
        f"<< /Type /Font /Subtype /Type1 /BaseFont /ABCDEF+Sans-Bold /FirstChar 130 /Widths [{' '.join('500' for _ in names)}] /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [130 {' '.join('/' + n for n in names)}] >> >>",
        "<< /Type /Font /Subtype /Type1 /BaseFont /Courier /ToUnicode 8 0 R >>", (cmap, ""), (form, " /Type /XObject /Subtype /Form /BBox [0 0 612 792]")]
    out = b"%PDF-1.5\n"
    for i, o in enumerate(objs, 1):
        if isinstance(o, tuple):
            data = o[0].encode("latin-1")
            out += f"{i} 0 obj << /Length {len(data)}{o[1]} >>\nstream\n".encode() + data + b"\nendstream endobj\n"
        else:
            out += f"{i} 0 obj {o} endobj\n".encode()
    return out + b"%%EOF"

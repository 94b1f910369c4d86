"""PDF bytes as a source: discovery, pages, page boxes, content operators, text runs, drawn rectangles.

Standard library only. Files come as rows of a `binaryFile` scan, and one bad file is a row with an error, not a failed job.
"""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_BOX = (0.0, 0.0, 612.0, 792.0)
MAX_PARENTS = 32
_OBJ = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)endobj", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+]?\d*\.\d+|[-+]?\d+|[A-Za-z'\"*]+")
_REF = rb"/%s\s+(\d+)\s+\d+\s+R"

RUNS = "path string, page_index int, seq int, text string, x0 double, y0 double, x1 double, y1 double, font_key string, font_size double, error string"
RECTS = "path string, page_index int, seq int, x0 double, y0 double, x1 double, y1 double, error string"
PAGES = "path string, page_index int, box array<double>, source string, n_bytes long, error string"


def discover(spark: SparkSession, root: str) -> DataFrame:
    """path and content of every .pdf below root, in any case of letters."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(root).select("path", "content")


def objects(data: bytes) -> dict[int, bytes]:
    return {int(m[1]): m[3] for m in _OBJ.finditer(data)}


def stream(body: bytes) -> bytes:
    """The object's stream, by its Length if that is a number, else up to endstream."""
    m = re.search(rb"stream\r?\n", body)
    if not m:
        return b""
    length = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", body[: m.start()])
    data = body[m.end() : m.end() + int(length[1])] if length else re.split(rb"\r?\nendstream", body[m.end() :])[0]
    return zlib.decompress(data) if b"/FlateDecode" in body[: m.start()] else data


def _box(objs: dict[int, bytes], page: bytes) -> tuple[tuple[float, ...], str]:
    """CropBox, else MediaBox, of the page or the nearest of MAX_PARENTS parents."""
    for kind in (b"CropBox", b"MediaBox"):
        at = page
        for _ in range(MAX_PARENTS):
            if m := re.search(rb"/" + kind + rb"\s*\[([^\]]*)\]", at):
                return tuple(float(x) for x in m[1].split())[:4], kind.decode()
            up = re.search(_REF % b"Parent", at)
            if not up or int(up[1]) not in objs:
                break
            at = objs[int(up[1])]
    return DEFAULT_BOX, "default"


def pages(data: bytes) -> list[tuple[int, tuple[float, ...], str, bytes]]:
    """(page_index, box, where the box is from, content) of each page object in file order."""
    if not data.startswith(b"%PDF"):
        raise ValueError("not a PDF")
    objs, out = objects(data), []
    for body in objs.values():
        if re.search(rb"/Type\s*/Page\b(?!s)", body):
            box, source = _box(objs, body)
            refs = re.search(rb"/Contents\s*\[([^\]]*)\]", body)
            ids = [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", refs[1])] if refs else [int(m[1]) for m in [re.search(_REF % b"Contents", body)] if m]
            out.append((len(out), box, source, b"\n".join(stream(objs.get(i, b"")) for i in ids)))
    return out


def _literal(tok: bytes) -> str:
    if tok[:1] == b"<":
        return bytes.fromhex(re.sub(rb"\s", b"", tok[1:-1]).decode()).decode("latin-1")
    return re.sub(rb"\\(.)", rb"\1", tok[1:-1]).decode("latin-1")


def operations(content: bytes):
    """(operator, operands) pairs."""
    stack: list = []
    array: list | None = None
    for m in _TOKEN.finditer(content):
        tok = m[0]
        if tok == b"[":
            array = []
            continue
        if tok == b"]":
            stack.append(array or [])
            array = None
            continue
        if tok[:1] in b"(<":
            value: object = _literal(tok)
        elif tok[:1] == b"/":
            value = tok[1:].decode("latin-1")
        elif tok[:1].isdigit() or tok[:1] in b"+-.":
            value = float(tok)
        else:
            yield tok.decode("latin-1"), stack
            stack = []
            continue
        (stack if array is None else array).append(value)


def newline_delta(lead: float, size: float) -> float:
    """How far a new line goes down: by the leading, if that is more than a hundredth, else by 1.2 sizes."""
    return -lead if abs(lead) > 0.01 else -1.2 * size


def rgb(n: list[float]) -> tuple[float, ...]:
    """Red, green and blue of a gray, RGB or CMYK colour."""
    return (n[0],) * 3 if len(n) == 1 else tuple(n[:3]) if len(n) == 3 else tuple(1 - min(1.0, v + n[3]) for v in n[:3]) if len(n) >= 4 else (1.0,) * 3


def text_runs(content: bytes, width=lambda s, size: 0.6 * size * len(s)) -> list[tuple]:
    """(text, x0, y0, x1, y1, font key, size) in order; only the translation of the text matrix is followed, and each shown string moves x by its width."""
    out: list[tuple] = []
    font, size, lead, x, y, lx, ly = "", 12.0, 0.0, 0.0, 0.0, 0.0, 0.0

    def show(s, shift=0.0):
        nonlocal x
        w = width(s, size) + shift
        if s:
            out.append((s, x, y - size, x + w, y, font, size))
        x += w

    for op, a in operations(content):
        if op == "BT":
            x = y = lx = ly = 0.0
        elif op == "Tf" and len(a) >= 2:
            font, size = str(a[0]), float(a[1])
        elif op == "TL" and a:
            lead = float(a[0])
        elif op == "Tm" and len(a) >= 6:
            x, y = float(a[4]), float(a[5])
            lx, ly = x, y
        elif op in ("Td", "TD") and len(a) >= 2:
            lx, ly = lx + float(a[0]), ly + float(a[1])
            x, y = lx, ly
            if op == "TD":
                lead = -float(a[1])
        elif op in ("T*", "'", '"'):
            ly += newline_delta(lead, size)
            x, y = lx, ly
            if op != "T*" and a:
                show(str(a[-1]))
        elif op == "Tj" and a:
            show(str(a[0]))
        elif op == "TJ" and a and isinstance(a[0], list):
            parts = a[0]
            begun = next((i for i, p in enumerate(parts) if isinstance(p, str)), len(parts))
            text = "".join(p for p in parts if isinstance(p, str))
            show(text, sum(-p / 1000 * size for p in parts[begun:] if isinstance(p, float)))
    return out


def drawn_rects(content: bytes) -> list[tuple]:
    """Rectangles made while the fill is black. A rectangle counts without a paint operator; the fill is black to begin with."""
    out, fill, saved = [], (0.0, 0.0, 0.0), []
    for op, a in operations(content):
        n = [v for v in a if isinstance(v, float)]
        if op == "q":
            saved.append(fill)
        elif op == "Q" and saved:
            fill = saved.pop()
        elif op in ("g", "rg", "k", "sc", "scn") and n:
            fill = rgb(n)
        elif op == "re" and len(n) == 4 and max(fill) <= 0.01:
            x, y, w, h = n
            out.append((min(x, x + w), min(y, y + h), max(x, x + w), max(y, y + h)))
    return out


def slices(batches, size: int = 200):
    """Batches in parts: what a task makes of its files is handed on part by part, however many rows a batch has."""
    for pdf in batches:
        for at in range(0, len(pdf), size):
            yield pdf.iloc[at : at + size]


def _each(batches, columns, rows):
    for pdf in slices(batches):
        out = []
        for path, data in zip(pdf["path"], pdf["content"]):
            try:
                out += [(path, *r, None) for r in rows(bytes(data))]
            except Exception as e:  # the file's own row says what is wrong
                out.append((path, *[None] * (len(columns) - 2), f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(out, columns=columns)


def _reader(schema: str, rows):
    columns = [c.strip().split()[0] for c in re.split(r",(?![^<]*>)", schema)]

    def read(files: DataFrame) -> DataFrame:
        return files.select("path", "content").mapInPandas(lambda it: _each(it, columns, rows), schema)

    return read


read_pages = _reader(PAGES, lambda d: [(i, list(b), s, len(c)) for i, b, s, c in pages(d)])
read_runs = _reader(RUNS, lambda d: [(i, k, *r) for i, _, _, c in pages(d) for k, r in enumerate(text_runs(c))])
read_rects = _reader(RECTS, lambda d: [(i, k, *r) for i, _, _, c in pages(d) for k, r in enumerate(drawn_rects(c))])


def make_pdf(lines: list[str], rects: list[tuple] = (), size: int = 12, compress: bool = True) -> bytes:
    """A one-page file with these lines and black rectangles."""
    esc = lambda s: re.sub(r"([\\()])", r"\\\1", s)
    body = "".join(f"0 g {x} {y} {w} {h} re f\n" for x, y, w, h in rects)
    body += f"BT /F1 {size} Tf 14 TL 72 720 Td " + "".join(f"({esc(line)}) Tj T* " for line in lines) + "ET"
    data = body.encode("latin-1", "replace")
    data, how = (zlib.compress(data), " /Filter /FlateDecode") if compress else (data, "")
    objs = ["<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 612 792] >>", "<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>"]
    out = b"%PDF-1.4\n" + b"".join(f"{i + 1} 0 obj {o} endobj\n".encode() for i, o in enumerate(objs))
    return out + f"4 0 obj << /Length {len(data)}{how} >>\nstream\n".encode() + data + b"\nendstream endobj\n%%EOF"


def rendered(docs: DataFrame) -> DataFrame:
    """path and content: each document's first lines as a PDF, with a box over its second line."""

    def run(batches):
        for pdf in slices(batches):
            rows = []
            for i, text in zip(pdf["doc_id"], pdf["text"]):
                lines = [" ".join(w[k : k + 10]) for w in [(text or "").split()] for k in range(0, len(w), 10)]
                rows.append((f"doc{i}.pdf", make_pdf(lines, [(72, 694, 90, 12)])))
            yield pd.DataFrame(rows, columns=["path", "content"])

    return docs.select("doc_id", "text").mapInPandas(run, "path string, content binary")


def manifest(parsed: DataFrame) -> DataFrame:
    """ok or error for each file, with counts."""
    return parsed.groupBy("path").agg(F.count("page_index").alias("rows_read"), F.max("error").alias("error")).withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("error"))

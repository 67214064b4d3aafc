"""DOCX, XLSX and PDF as binaries: rewriting and restoring text in place, and checks that nothing is left."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable
from html import escape, unescape

#: text -> replacements (start, end, new)
Finder = Callable[[str], list[tuple[int, int, str]]]

_DOCX_PARTS = re.compile(r"^word/(?:document|header[0-9]*|footer[0-9]*|footnotes|endnotes|comments)\.xml$")
_PROPERTIES = re.compile(r"^docProps/(?:core|app|custom)\.xml$")
_PARAGRAPH = re.compile(r"<w:p[ >].*?</w:p>", re.S)
_RUN_TEXT = re.compile(r"(<w:(?:t|delText)(?: [^>]*)?>)([^<]*)(</w:(?:t|delText)>)")
_AUTHOR = re.compile(r'(w:(?:author|initials)=")[^"]*(")')
_PROPERTY = re.compile(r"(<(?:dc:creator|cp:lastModifiedBy|dc:title|dc:subject|dc:description|cp:keywords|Company|Manager)>)([^<]*)(</)")


def _over_nodes(texts: list[str], replacements: list[tuple[int, int, str]]) -> list[str]:
    """Replacements over the joined text, put into the nodes that hold it: the new text goes to a span's first node."""
    bounds, at = [], 0
    for t in texts:
        bounds.append((at, at + len(t)))
        at += len(t)
    out = list(texts)
    for start, end, new in sorted(replacements, reverse=True):
        first = True
        for i, (a, b) in enumerate(bounds):
            lo, hi = max(start, a), min(end, b)
            if lo < hi:
                piece = out[i]
                out[i] = piece[: lo - a] + (new if first else "") + piece[hi - a :]
                first = False
    return out


def _rezip(data: bytes, change: Callable[[str, bytes], bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as source, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        for info in source.infolist():
            target.writestr(info.filename, change(info.filename, source.read(info.filename)))
    return out.getvalue()


def _rewrite_paragraph(xml: str, find: Finder) -> str:
    runs = list(_RUN_TEXT.finditer(xml))
    texts = [unescape(m.group(2)) for m in runs]
    found = find("".join(texts))
    if not found:
        return xml
    new = iter(_over_nodes(texts, found))
    return _RUN_TEXT.sub(lambda m: m.group(1) + escape(next(new), quote=False) + m.group(3), xml)


def _replace_all(text: str, find: Finder) -> str:
    for start, end, new in sorted(find(text), reverse=True):
        text = text[:start] + new + text[end:]
    return text


def rewrite_docx(data: bytes, find: Finder, strip_authors: bool = True) -> bytes:
    """Spans are found in a paragraph's joined runs; properties and authors are rewritten too."""

    def change(name: str, raw: bytes) -> bytes:
        if _DOCX_PARTS.match(name):
            xml = _PARAGRAPH.sub(lambda m: _rewrite_paragraph(m.group(), find), raw.decode("utf-8"))
            return (_AUTHOR.sub(r"\1\2", xml) if strip_authors else xml).encode()
        if _PROPERTIES.match(name):
            keep = r"creator|lastModifiedBy"
            return _PROPERTY.sub(lambda m: m.group(1) + ("" if strip_authors and re.search(keep, m.group(1)) else escape(_replace_all(unescape(m.group(2)), find), quote=False)) + m.group(3), raw.decode("utf-8")).encode()
        return raw

    return _rezip(data, change)


def docx_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return "\n".join("".join(unescape(t.group(2)) for t in _RUN_TEXT.finditer(p.group())) for n in z.namelist() if _DOCX_PARTS.match(n) for p in _PARAGRAPH.finditer(z.read(n).decode("utf-8")))


_SI = re.compile(r"<si>.*?</si>|<is>.*?</is>", re.S)
_T = re.compile(r"(<t(?: [^>]*)?>)([^<]*)(</t>)")
_FORMULA_STRING = re.compile(r'(<c [^>]*t="str"[^>]*>(?:<f[^>]*>[^<]*</f>)?<v>)([^<]*)(</v>)')


def rewrite_xlsx(data: bytes, find: Finder) -> bytes:
    """Shared and inline strings (rich text by its joined runs) and string results of formulas, on all sheets."""

    def cell(m: re.Match) -> str:
        runs = list(_T.finditer(m.group()))
        texts = [unescape(r.group(2)) for r in runs]
        found = find("".join(texts))
        if not found:
            return m.group()
        new = iter(_over_nodes(texts, found))
        return _T.sub(lambda r: r.group(1) + escape(next(new), quote=False) + r.group(3), m.group())

    def change(name: str, raw: bytes) -> bytes:
        if name == "xl/sharedStrings.xml" or name.startswith("xl/worksheets/") and name.endswith(".xml"):
            xml = _SI.sub(cell, raw.decode("utf-8"))
            return _FORMULA_STRING.sub(lambda m: m.group(1) + escape(_replace_all(unescape(m.group(2)), find), quote=False) + m.group(3), xml).encode()
        return raw

    return _rezip(data, change)


def xlsx_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts = [z.read(n).decode("utf-8") for n in z.namelist() if n == "xl/sharedStrings.xml" or n.startswith("xl/worksheets/") and n.endswith(".xml")]
    cells = ["".join(unescape(t.group(2)) for t in _T.finditer(m.group())) for p in parts for m in _SI.finditer(p)]
    return "\n".join(cells + [unescape(m.group(2)) for p in parts for m in _FORMULA_STRING.finditer(p)])


def assert_contains_none(data: bytes, originals: list[str]) -> None:
    """Raises if an original stands in any part of a zip container, XML-decoded, runs joined."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in z.namelist():
            if name.endswith((".xml", ".rels")):
                xml = z.read(name).decode("utf-8", "replace")
                plain = unescape(re.sub(r"<[^>]+>", "", xml)) + "\n" + unescape(xml)
                for o in originals:
                    if o and o in plain:
                        raise ValueError(f"an original is left in {name}")


_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_LITERAL = re.compile(rb"\(((?:[^()\\]|\\.)*)\)\s*(?:Tj|'|\")|\[((?:[^\]\\]|\\.)*)\]\s*TJ|<([0-9A-Fa-f\s]+)>\s*Tj", re.S)


def _pdf_string(raw: bytes) -> str:
    raw = re.sub(rb"\\([0-7]{1,3})", lambda m: bytes([int(m.group(1), 8) & 255]), raw)
    raw = re.sub(rb"\\(.)", lambda m: {b"n": b"\n", b"r": b"\r", b"t": b"\t"}.get(m.group(1), m.group(1)), raw, flags=re.S)
    if raw.startswith(b"\xfe\xff"):
        return raw[2:].decode("utf-16-be", "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("cp1251", "replace")


def pdf_text(data: bytes) -> str:
    out = []
    for m in _STREAM.finditer(data):
        body = m.group(1)
        try:
            body = zlib.decompress(body)
        except zlib.error:
            pass
        for t in _LITERAL.finditer(body):
            if t.group(1) is not None:
                out.append(_pdf_string(t.group(1)))
            elif t.group(2) is not None:
                out.append("".join(_pdf_string(p) for p in re.findall(rb"\(((?:[^()\\]|\\.)*)\)", t.group(2))))
            else:
                out.append(_pdf_string(bytes.fromhex(re.sub(rb"\s", b"", t.group(3)).decode())))
    return "\n".join(out)


def assert_pdf_contains_none(data: bytes, originals: list[str]) -> None:
    text = pdf_text(data)
    for o in originals:
        if o and (o in text or any(o.encode(e, "ignore") in data for e in ("utf-8", "utf-16-be", "utf-16-le", "cp1251") if o.encode(e, "ignore"))):
            raise ValueError("an original is left in the document")


def pdf_placeholders(data: bytes) -> list[str]:
    return re.findall(r"\[[A-Z][A-Z_]*_[0-9]+\]", pdf_text(data))

"""Readers of file contents: HTML, RTF, OOXML, ODF and text, to marker-tagged text. Each works on one file's bytes."""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.sources.encodings import decoded

# Lanes of extraction by file extension.
LANES = {"pdf": ("pdf",), "word": ("docx", "doc", "odt", "rtf"), "spreadsheet": ("xlsx", "xls", "ods", "csv"), "presentation": ("pptx", "ppt", "odp"), "image": ("png", "jpg", "jpeg", "gif", "bmp", "tiff", "webp")}
ATTACHMENTS = ("pdf", "docx", "doc", "xlsx", "xls", "pptx", "odt", "rtf", "txt", "md", "csv")


class _Text(HTMLParser):
    SKIPPED = {"script", "style", "head", "noscript", "template", "svg"}
    BLOCKS = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "section", "article", "header", "footer", "nav", "aside", "main", "blockquote", "pre", "hr", *(f"h{i}" for i in range(1, 7))}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skipping = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIPPED:
            self.skipping += 1
        if tag in self.BLOCKS:
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append("\t")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIPPED and self.skipping:
            self.skipping -= 1
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.out.append(re.sub(r"\s+", " ", data))


def html_text(html: str) -> str:
    parser = _Text()
    parser.feed(html)
    parser.close()
    lines = [re.sub(r"[ \t]+", " ", x).strip() for x in "".join(parser.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip() or "[The page has no readable text]"


_RTF = re.compile(r"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\(.)|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.DOTALL)
# Groups that hold no text of the document, and control words that stand for characters.
_RTF_SKIPPED = set("fonttbl colortbl stylesheet info pict object themedata colorschememapping datastore latentstyles listtable listoverridetable rsidtbl generator xmlnstbl".split())
_RTF_SIGNS = {"par": "\n\n", "sect": "\n\n", "page": "\n\n", "line": "\n", "row": "\n", "tab": "\t", "cell": "\t", "emdash": "-", "endash": "-", "lquote": "'", "rquote": "'", "ldblquote": '"', "rdblquote": '"'}


def rtf_text(raw: str) -> str:
    """Control words, hex and Unicode escapes (with their fallback characters skipped), without the listed groups.

    Headers, footers and footnotes stay. Paragraphs are a blank line apart, soft breaks are not.
    """
    out: list[str] = []
    stack: list[bool] = []
    hidden, fallback, skip = False, 1, 0
    for word, number, code, sign, brace, text in (m.groups() for m in _RTF.finditer(raw)):
        if brace == "{":
            stack.append(hidden)
        elif brace == "}":
            hidden = stack.pop() if stack else False
        elif hidden:
            continue
        elif word in _RTF_SKIPPED or sign == "*":
            hidden = True
        elif word == "uc":
            fallback = int(number or 1)
        elif word == "u":
            if number:
                out.append(chr(int(number) % 65536))
                skip = fallback
        elif word:
            out.append(_RTF_SIGNS.get(word, ""))
        elif sign:
            out.append({"~": " ", "\\": sign, "{": sign, "}": sign}.get(sign, ""))
        elif code or text:
            piece = bytes.fromhex(code).decode("cp1252", errors="replace") if code else text
            used = min(skip, len(piece))
            skip -= used
            out.append(piece[used:])
    return "".join(out).strip() or "[The RTF file has no readable text]"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _paragraphs(root: ElementTree.Element, paragraph: str, text: tuple[str, ...]) -> list[str]:
    out = []
    for p in root.iter():
        if _local(p.tag) == paragraph:
            line = "".join("\t" if _local(x.tag) == "tab" else "\n" if _local(x.tag) == "br" else (x.text or "") if _local(x.tag) in text else "" for x in p.iter())
            if line.strip():
                out.append(line)
    return out


def _numbered(names: list[str], pattern: str) -> list[tuple[int, str]]:
    return sorted((int(m.group(1)), n) for n in names if (m := re.match(pattern, n)))


def _column(reference: str) -> int:
    """The place of a cell such as BC7, from 0; -1 without one."""
    n = 0
    for x in re.match(r"[A-Z]*", reference)[0]:
        n = n * 26 + ord(x) - 64
    return n - 1


def office_text(raw: bytes, extension: str) -> str:
    """docx, pptx, xlsx and odt by their XML parts."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        root = lambda n: ElementTree.fromstring(z.read(n))
        if extension == "docx":
            parts = sorted(n for n in names if re.match(r"word/header\d*\.xml", n)) + ["word/document.xml"] + [n for n in names if n == "word/footnotes.xml"]
            return "\n\n".join(x for n in parts for x in _paragraphs(root(n), "p", ("t",)))
        if extension == "pptx":
            out = []
            for i, n in _numbered(names, r"ppt/slides/slide(\d+)\.xml$"):
                notes = f"ppt/notesSlides/notesSlide{i}.xml"
                out.append("\n".join([f"[[slide:{i}]]", *_paragraphs(root(n), "p", ("t",)), *(_paragraphs(root(notes), "p", ("t",)) if notes in names else [])]))
            return "\n".join(out)
        if extension == "odt":
            body = root("content.xml")
            return "\n\n".join("".join(p.itertext()) for p in body.iter() if _local(p.tag) in ("p", "h") and "".join(p.itertext()).strip())
        shared = ["".join(t.text or "" for t in s.iter() if _local(t.tag) == "t") for s in root("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        titles = [s.attrib["name"] for s in root("xl/workbook.xml").iter() if _local(s.tag) == "sheet"]
        out = []
        for i, n in _numbered(names, r"xl/worksheets/sheet(\d+)\.xml$"):
            rows = []
            for r in root(n).iter():
                if _local(r.tag) != "row":
                    continue
                cells = []
                for c in (x for x in r if _local(x.tag) == "c"):
                    value = "".join(v.text or "" for v in c.iter() if _local(v.tag) in ("v", "t"))
                    place = _column(c.attrib.get("r", ""))
                    cells += [""] * (place - len(cells))  # cells without a value are not written
                    cells.append(shared[int(value)] if c.attrib.get("t") == "s" and value else value)
                if any(cells):
                    rows.append("\t".join(cells))
            out.append("\n\n".join([f"[[sheet:{titles[i - 1] if i <= len(titles) else i}]]", *rows]))
        return "\n".join(out)


def extracted(raw: bytes, name: str) -> str:
    """Text by extension; what cannot be read gives a reason in brackets."""
    extension = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    try:
        if extension in ("html", "htm"):
            return html_text(decoded(raw))
        if extension == "rtf":
            return rtf_text(raw.decode("latin-1"))
        if extension in ("docx", "pptx", "xlsx", "odt"):
            return office_text(raw, extension)
        if extension == "doc":
            return "[Legacy Word files cannot be read]"
        if extension in LANES["pdf"] or extension in LANES["image"]:
            return f"[No reader for .{extension} here; give its extracted text]"
        return decoded(raw)
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError) as e:
        return f"[The file could not be read: {e}]"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """name, size, content_hash, text, status of all files below a path; files are dealt to tasks by Spark."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    @F.pandas_udf("string")
    def text(raw: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([extracted(a, b) for a, b in zip(raw, name, strict=True)])

    name = F.element_at(F.split("path", "/"), -1)
    out = files.select(name.alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("content_hash"), text(F.col("content"), name).alias("text"))
    return out.withColumn("status", outcome(F.col("text")))


@F.pandas_udf(StringType())
def html_column(html: pd.Series) -> pd.Series:
    return html.map(lambda x: None if x is None else html_text(x))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def lane(name: Column) -> Column:
    out = F.lit("text")
    for k, v in LANES.items():
        out = F.when(extension(name).isin(*v), k).otherwise(out)
    return out


def is_attachment(name: Column) -> Column:
    return extension(name).isin(*ATTACHMENTS)


def outcome(text: Column) -> Column:
    """ok, unless the text is a reason in brackets with no more than 20 characters after it."""
    rest = F.trim(F.regexp_replace(text, r"^\[[^\]]*\]\n?", ""))
    return F.when(~text.startswith("["), "ok").when(text.rlike(r"^\[[^\]]*\]\n") & (F.length(rest) > 20), "ok").otherwise("failed")


def is_scanned(text: Column, pages: Column) -> Column:
    """Fewer than 24 visible characters a page."""
    return F.length(F.regexp_replace(text, r"\s+", "")) < 24 * pages

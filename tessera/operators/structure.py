"""Document structure: lines, pages, running lines, headings, chunks, defined terms, citations.

Line-level work (positions, pages, running headers) is windows and aggregates over one row per line. Only the
chunker itself, whose state runs through a document, is a small Python state machine inside ``mapInArrow``; it sees
one document at a time and gives one row per chunk.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The marker lines of extracted text, and the sizes of chunks in bytes.
MARKER = r"^\[\[(page|slide|sheet|image|clear):([^\]]*)\]\]$"
TARGET_BYTES, MOST_BYTES, OVERLAP_BYTES, SHEET_BYTES = 1400, 2800, 200, 900


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 1), line: one row per line; a carriage return before the break is no part of it."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\r?\n")).alias("n", "line")).select(key, (F.col("n") + 1).alias("line_no"), "line")


def paged(rows: DataFrame, key: str) -> DataFrame:
    """Lines with the page that the last marker before them names; lines before any marker have none."""
    number = F.regexp_extract("line", r"^\[\[page:(\d+)\]\]$", 1)
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("page", F.last(F.when(number != "", number.cast("int")), ignorenulls=True).over(w))
    return marked.where(number == "")


def line_key(line: Column) -> Column:
    """Digits as #, white space as single spaces: lines that differ in a page number only are one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]+", "#"), r"\s+", " "))


def boilerplate(rows: DataFrame, key: str, edge: int = 3, least_pages: int = 3, most: int = 80) -> DataFrame:
    """Running headers and footers: keys of short lines at the top or bottom of at least half of the pages."""
    p = rows.where("trim(line) <> '' AND page IS NOT NULL")
    w = Window.partitionBy(key, "page")
    p = p.withColumn("top", F.row_number().over(w.orderBy("line_no"))).withColumn("bottom", F.row_number().over(w.orderBy(F.desc("line_no"))))
    pages = p.groupBy(key).agg(F.count_distinct("page").alias("pages"))
    k = p.where((F.col("top") <= edge) | (F.col("bottom") <= edge)).where(F.length("line") <= most).groupBy(key, line_key(F.col("line")).alias("line_key")).agg(F.count_distinct("page").alias("on_pages"))
    return k.join(pages, key).where((F.col("pages") >= least_pages) & (F.col("on_pages") >= F.greatest(F.lit(3), F.ceil(F.col("pages") / 2)))).select(key, "line_key", "on_pages", "pages")


def is_contents(text: Column) -> Column:
    """Two lines or more end in leader dots and a page number."""
    return F.regexp_count(text, F.lit(r"(?m)\.{3,}\s*\d+\s*$")) >= 2


def clean(text: Column) -> Column:
    """Without marker lines, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?m)^\[\[[a-z]+:[^\]]*\]\]\n?", ""))


def page_text(rows: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """The text of a range of pages, lines in order."""
    wanted = rows.where(F.col("page").between(first, last)).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return wanted.select(key, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def citation(page_from: Column, page_to: Column, section: Column, location: Column | None = None, row_from: Column | None = None, row_to: Column | None = None) -> Column:
    """p. 3, pp. 3-5, or Sheet: Fees, rows 2-9; with the section's label where there is one."""
    span = lambda one, many, a, b: F.when(a.isNull(), F.lit(None)).when(b.isNull() | (b == a), F.concat(F.lit(one), a)).otherwise(F.concat(F.lit(many), a, F.lit("-"), b))
    none = F.lit(None).cast("string")
    rows = none if row_from is None else span("row ", "rows ", row_from, row_to)
    return F.concat_ws(", ", none if location is None else location, rows, span("p. ", "pp. ", page_from, page_to), section)


def neighbours(chunks: DataFrame, key: str, reach: int = 1) -> DataFrame:
    """Each chunk with the span of chunks of its own document within ``reach``."""
    w = Window.partitionBy(key).orderBy("ord").rangeBetween(-reach, reach)
    return chunks.withColumn("first_ord", F.min("ord").over(w)).withColumn("last_ord", F.max("ord").over(w))


def section_openings(chunks: DataFrame, key: str, label: str, most: int = 2) -> DataFrame:
    """The first chunks of each run of consecutive chunks with one label."""
    island = F.col("ord") - F.row_number().over(Window.partitionBy(key, label).orderBy("ord"))
    c = chunks.withColumn("island", island)
    return c.withColumn("n", F.row_number().over(Window.partitionBy(key, label, "island").orderBy("ord"))).where(F.col("n") <= most).drop("island", "n")


# Words that make a heading with the number after them; those of the first list stand at the top level.
TOP_WORDS = (
    "article artículo articulo artigo artikel articolo art. chapter capítulo capitulo kapitel chapitre part parte teil titre título titulo schedule annex anexo anlage annexe allegato exhibit appendix apéndice apendice статья глава раздел"
).split()
WORDS = "section sección seccion secção seção abschnitt paragraph párrafo paragraphe clause cláusula clausula klausel clausola пункт खंड धारा अनुच्छेद §".split()
RECITALS = ("WHEREAS", "NOW, THEREFORE", "NOW THEREFORE", "RECITALS", "CONSIDERANDO", "ATTENDU QUE", "PRÄAMBEL")

_KIND = "|".join(sorted(map(re.escape, TOP_WORDS + WORDS), key=len, reverse=True))
_LABELLED = re.compile(rf"(?i)^({_KIND})(\s*)((?:[ivxlcdm]+|\d+)(?:\.(?:[ivxlcdm]+|\d+))*(?:\s*\([a-z0-9]+\))*)(?![a-z0-9])\s*[:.)\-–—]?\s*(.*)$")
_CJK = re.compile(r"^(第\s*[一二三四五六七八九十百千零〇0-9]+\s*([条條章节節款编編部]))\s*(.{0,40})")
_NUMBERED = re.compile(r"^((?:\d{1,3}\.)+\d{0,3}|\d{1,3}\)|\([a-z]{1,3}\)|\([ivxlcdm]{1,6}\))\s+(\S.*)$")
_CONTENTS = re.compile(r"\.{3,}\s*\d+\s*$")
_LIST = re.compile(r"^(?:[•●▪■◦‣∙·–—*-]|o\s|\([a-z0-9]{1,4}\)|[a-z0-9]{1,3}\))")
_MARKER = re.compile(r"^\[\[(page|slide|sheet|image|clear):([^\]]*)\]\](?:\s*\(OCR\))?$")


def _in_capitals(s: str) -> bool:
    letters = [c for c in s if c.isalpha() and c.lower() != c.upper()]
    return 4 <= len(s) <= 80 and len(letters) >= 3 and all(c.isupper() for c in letters) and not re.search(r"[.;:?!]$", s)


def heading(line: str) -> tuple[int, str] | None:
    """(level, label) of a line that is a heading, else None.

    Questions are deeper than all numbered levels (9), so that a row of them stands under the section before it; words
    of TOP_WORDS, recitals and lines in capitals are at level 1, other words and numbers as deep as their number has parts.
    """
    s = line.strip()
    if not s or len(s) > 160 or _CONTENTS.search(s):
        return None
    words = s.split()
    if s[-1] == "?" and 2 <= len(words) <= 20 and not _LIST.match(s) and next((c for c in s if c.isalpha()), "a").isupper():
        return 9, s
    if m := _LABELLED.match(s):
        kind, gap, number, title = m.group(1), m.group(2), m.group(3).strip(), m.group(4).strip()
        # "Section 5 of the Act applies" is prose
        prose = len(title) > 60 or title[:1].islower() or (title.endswith(".") and len(title.split()) > 6)
        if (gap or kind == "§" or kind.endswith(".")) and not prose:
            level = 1 if kind.lower() in TOP_WORDS else len([x for x in re.split(r"[.(]", number) if x.strip(" )")])
            name = f"{kind[:1].upper()}{kind[1:]} {number}"
            return level, f"{name}: {title}" if title else name
    if m := _CJK.match(s):
        return (1 if m.group(2) in "章编編部" else 2), f"{m.group(1)} {m.group(3).strip()}".strip()
    if any(re.match(rf"{re.escape(x)}\b", s) for x in RECITALS):
        return 1, s[:60]
    if _in_capitals(s):
        return 1, s
    if len(s) <= 90 and (m := _NUMBERED.match(s)):
        mark, title = m.groups()
        if title[0].isupper() and len(title) <= 70 and title[-1] not in ".;":
            return (3 if mark[0] == "(" else len([x for x in re.split(r"[.)]", mark) if x])), s
    return None


def heading_level(line: str) -> int | None:
    found = heading(line)
    return found[0] if found else None


def split_point(text: str, most: int) -> int:
    """Where to cut a text whose UTF-8 form is longer than ``most`` bytes: a sentence end in the second half, else white space, else a character border."""
    raw = text.encode()
    head = raw[:most].decode(errors="ignore")
    half = len(head) // 2
    ends = [m.end() for m in re.finditer(r"[.!?。！？](?=\s|$)", head) if m.end() > half]
    if ends:
        return ends[-1]
    spaces = [m.end() for m in re.finditer(r"\s", head) if m.end() > half]
    return spaces[-1] if spaces else max(1, len(head))


class Line(NamedTuple):
    start: int
    end: int
    text: str


def _lines(text: str) -> list[Line]:
    """The lines with their bytes, without white space at the ends."""
    out, at = [], 0
    for line in text.split("\n"):
        size, bare = len(line.encode()), line.strip()
        start = at + len(line[: len(line) - len(line.lstrip())].encode())
        out.append(Line(start, start + len(bare.encode()), bare))
        at += size + 1
    return out


def running_lines(rows: list[Line], edge: int = 3, least_pages: int = 3, most: int = 80) -> set[int]:
    """Places of lines that are no text of their page: numbers alone, and lines that recur at the edges of half of the pages."""
    pages: list[list[int]] = []
    for i, row in enumerate(rows):
        if (m := _MARKER.match(row.text)) and m.group(1) == "page":
            pages.append([])
        elif pages and row.text and not m:
            pages[-1].append(i)
    keys: dict[str, set[int]] = {}
    edges = [(n, i) for n, page in enumerate(pages) for i in dict.fromkeys(page[:edge] + page[-edge:])]
    for n, i in edges:
        keys.setdefault(_line_key(rows[i].text), set()).add(n)
    enough = max(least_pages, -(-len(pages) // 2))
    alone = re.compile(r"[#\s/|-]{0,11}#[#\s/|-]{0,11}")
    return {i for _, i in edges if alone.fullmatch(k := _line_key(rows[i].text)) or (len(keys[k]) >= enough and len(k) <= most)}


def _line_key(line: str) -> str:
    return " ".join(re.sub(r"[0-9]+", "#", line.lower()).split())


class Unit(NamedTuple):
    kind: str
    start: int
    end: int
    label: str


def units(text: str) -> list[Unit]:
    """What chunks are put together from: markers, headings, rows of sheets, and runs of text lines.

    A blank line, a heading, a list item and a running line each end a run. A title in capitals over two lines is one heading.
    In a sheet every paragraph is a row, whatever it looks like.
    """
    rows, out, sheet = _lines(text), [], False
    skipped = running_lines(rows)
    open_ = False
    for i, (start, end, line) in enumerate(rows):
        if not line:
            open_ = False
        elif m := _MARKER.match(line):
            sheet, open_ = m.group(1) == "sheet", False
            out.append(Unit(f"[{m.group(1)}", start, end, m.group(2).strip()))
        elif sheet:
            if open_:
                out[-1] = out[-1]._replace(end=end)
            else:
                out.append(Unit("row", start, end, ""))
            open_ = True
        elif i in skipped:
            open_ = False
        elif found := heading(line):
            last = out[-1] if out else None
            if open_ and last.kind == "heading" and _in_capitals(line) and not line[0].isdigit() and _in_capitals(last.label.split("\t")[1]):
                level, label = last.label.split("\t")
                if len(label) + len(line) <= 160:
                    out[-1] = Unit("heading", last.start, end, f"{level}\t{label} {line}")
                    continue
            out.append(Unit("heading", start, end, f"{found[0]}\t{found[1]}"))
            open_ = True
        elif open_ and out[-1].kind == "text" and not _LIST.match(line):
            out[-1] = out[-1]._replace(end=end)
        else:
            out.append(Unit("text", start, end, ""))
            open_ = True
    return out


def chunk(text: str) -> list[dict]:
    """Chunks of one marker-tagged text: byte range, pages, heading path, location, rows, header, whether it is a contents list.

    A heading begins a chunk, as does a change of page or location, and what would make a chunk longer than TARGET_BYTES; a
    unit over MOST_BYTES is cut with an overlap. Rows of a sheet are numbered from 1 (its header), some to a chunk, and each chunk after the first one
    has the header's bytes as its prefix. All text but markers and running lines is in some chunk.
    """
    raw = text.encode()
    out: list[dict] = []
    stack: list[tuple[int, str]] = []
    page = place = header = None
    row = 0
    held: dict | None = None

    def give(start: int, end: int, **more) -> dict:
        return {"byte_start": start, "byte_end": end, "page": page, "page_to": page, "section": " › ".join(s for _, s in stack), "location": place, "row_from": None, "row_to": None, "prefix_start": None, "prefix_end": None, **more}

    def close() -> None:
        nonlocal held
        if held:
            out.append(held)
        held = None

    for kind, start, end, label in units(text):
        if kind[0] == "[":
            now = (int(label), None) if kind == "[page" and label.isdigit() else (None, None) if kind == "[clear" else (page, place) if kind == "[page" else (None, f"{kind[1:].capitalize()}: {label}")
            if now != (page, place):
                close()
                (page, place), header, row = now, None, 0
            continue
        if kind == "row":
            row += 1
            if held and end - held["byte_start"] > SHEET_BYTES:
                close()
            if held:
                held.update(byte_end=end, row_to=row)
            else:
                held = give(start, end, section="", row_from=row, row_to=row, **({"prefix_start": header[0], "prefix_end": header[1]} if header else {}))
            header = header or (start, end)
            continue
        if kind == "heading":
            close()
            level, name = label.split("\t")
            while stack and stack[-1][0] >= int(level):
                stack.pop()
            stack.append((int(level), name))
        if end - start > MOST_BYTES:
            close()
            at = start
            while at < end:
                rest = raw[at:end].decode()
                size = len(rest.encode()) if end - at <= TARGET_BYTES else len(rest[: split_point(rest, TARGET_BYTES)].encode())
                piece = raw[at : at + size].decode()
                lead = len(piece[: len(piece) - len(piece.lstrip())].encode())
                if piece.strip():
                    out.append(give(at + lead, at + lead + len(piece.strip().encode())))
                if at + size >= end:
                    break
                # the next piece begins some words earlier, if that is still ahead of this one
                back = raw[at + size - OVERLAP_BYTES : at + size].decode(errors="ignore") if size > 2 * OVERLAP_BYTES else ""
                word = re.search(r"\s", back)
                at += size - (len(back[word.end() :].encode()) if word else len(back.encode()))
            continue
        if held and end - held["byte_start"] > TARGET_BYTES:
            close()
        if held:
            held["byte_end"] = end
        else:
            held = give(start, end)
    close()
    for n, c in enumerate(out):
        body = _cleaned(raw[c["byte_start"] : c["byte_end"]].decode())
        c["ord"], c["is_toc"] = n, sum(bool(_CONTENTS.search(x)) for x in body.split("\n")) >= 2
        c["text"] = with_prefix(raw, c["prefix_start"], c["prefix_end"], body)
    return [c for c in out if c["text"].strip()]


def _cleaned(text: str) -> str:
    return "\n".join(x for x in text.split("\n") if not _MARKER.match(x.strip()))


def with_prefix(raw: bytes, start: int | None, end: int | None, body: str) -> str:
    """A chunk as it is searched and shown: the header's line before the body, where there is one."""
    return body if start is None or end is None or start >= end else f"{_cleaned(raw[start:end].decode())}\n{body}"


CHUNK = "ord int, byte_start long, byte_end long, page int, page_to int, section string, location string, row_from int, row_to int, prefix_start long, prefix_end long, is_toc boolean, text string"


#: Documents that are cut before their chunks are handed on, and chunks that are handed on at once.
CUT, HANDED = 64, 1024


def chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per chunk of each document. A null or empty text has none.

    Documents leave Arrow a few at a time, and so do their chunks.
    """
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [pa.field(x.split()[0], kinds[x.split()[1]]) for x in CHUNK.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([batch.schema.field(0).with_name(key), *fields])
            for at in range(0, batch.num_rows, CUT):
                part = batch.slice(at, CUT)
                rows = [{key: k, **c} for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if t for c in chunk(t)]
                for i in range(0, len(rows), HANDED):
                    yield pa.RecordBatch.from_pylist(rows[i : i + HANDED], schema=schema)

    return docs.select(key, text).mapInArrow(task, f"{key} {docs.schema[key].dataType.simpleString()}, {CHUNK}")


#: A quoted term with a verb of definition, or a quoted term in brackets.
DEFINED = r"[\"“]([^\"”“]{2,80})[\"”]\s+(?:shall mean|means|bedeutet|signifie|significa)|\(\s*(?:the\s+)?[\"“]([^\"”“]{2,80})[\"”]\s*\)"


def defined_terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, place (in order of first definition); of one spelling in lower case the first counts; at most eight words."""
    one, two = (F.regexp_extract_all(F.col(text), F.lit(DEFINED), F.lit(i)) for i in (1, 2))
    both = F.zip_with(one, two, lambda a, b: F.when(F.coalesce(a, F.lit("")) != "", a).otherwise(b))
    t = docs.select(key, F.posexplode(both).alias("place", "term")).where(F.size(F.split("term", r"\s+")) <= 8)
    w = Window.partitionBy(key, F.lower("term")).orderBy("place")
    return t.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


#: A number in Roman digits, in small letters.
ROMAN = r"(?=[ivxlcdm])m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
# Chinese digits and the powers of ten that follow them.
CJK_DIGITS, CJK_TENS = "零〇一二三四五六七八九", {"十": 10, "百": 100, "千": 1000}


def cjk_number(written: Column) -> Column:
    """The value of a number in Chinese or Arabic digits; null for anything else."""
    plain = F.translate(written, CJK_DIGITS, "00123456789")
    zero = F.lit(0).cast("long")

    def step(state: Column, c: Column) -> Column:
        power = F.lit(0)
        for sign, value in CJK_TENS.items():
            power = F.when(c == sign, value).otherwise(power)
        total = state["total"] + F.greatest(state["now"], F.lit(1)) * power
        return F.when(power > 0, F.struct(total.alias("total"), zero.alias("now"))).otherwise(F.struct(state["total"].alias("total"), c.try_cast("long").alias("now")))

    value = F.aggregate(F.filter(F.split(plain, ""), lambda c: c != ""), F.struct(zero.alias("total"), zero.alias("now")), step, lambda s: s["total"] + s["now"])
    return F.when(plain.rlike("^[0-9]+$"), plain.try_cast("long")).when(plain.rlike("^[0-9十百千]+$"), value)


def section_key(label: Column) -> Column:
    """12.3(b) and Section 12.3 (b) are 12.3.(b), Article IV is iv, 第十二条 is 12; empty without a number.

    Roman numerals count right after the first word only.
    """
    cjk = cjk_number(F.regexp_extract(label, r"第\s*([一二三四五六七八九十百千零〇0-9]+)\s*[条條章节節款编編部]", 1))
    pattern = r"(\d+(?:\.\d+)*)\s*((?:\([a-z0-9]+\))*)"
    number, letters = F.regexp_extract(label, pattern, 1), F.regexp_extract(label, pattern, 2)
    roman = F.regexp_extract(F.lower(label), rf"^\s*\S+\s+({ROMAN})(?![\p{{L}}\p{{N}}])", 1)
    latin = F.when(number == "", roman).when(letters == "", number).otherwise(F.concat(number, F.lit("."), letters))
    return F.coalesce(cjk.cast("string"), latin)


def in_section(key: Column, wanted: str) -> Column:
    return (key == wanted) | key.startswith(wanted + ".")

"""Question routes, file hints and date windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest range of pages that is answered page by page.
MOST_PAGES = 10

# Patterns in the order in which they decide; all keep to what Java and RE2 share.
PAGE = r"\b(?:page|pages|p\.|pp\.|seite|seiten|página|páginas|pages?)\s*(\d{1,4})(?:\s*(?:-|–|to|bis|a|à)\s*(\d{1,4}))?"
CJK_PAGE = r"第\s*(\d{1,4})\s*[页頁]"
SECTION = r"\b(?:section|clause|article|artikel|abschnitt|sección|cláusula|artículo|§)\s*(\d+(?:\.\d+)*(?:\([a-z]\))*)"
DEFINITION = r"\b(?:definition of|define|meaning of|what does .* mean|bedeutung|définition|definición)\b"
QUOTED = r"[\"“]([^\"”]{2,60})[\"”]"
COVERAGE = r"\b(?:all documents|each document|every document|across|compare|summari[sz]e all|overview|alle dokumente|tous les documents|todos los documentos)\b"
FILE = r"([\p{L}\p{N}_\-]+\.(?:pdf|docx?|xlsx?|pptx?|txt|md|csv|html?|rtf|odt))\b"


def route(question: Column) -> Column:
    """page, section, definition, coverage or semantic."""
    low = F.lower(question)
    a, b = F.regexp_extract(low, PAGE, 1), F.regexp_extract(low, PAGE, 2)
    pages = (a != "") & ((b == "") | (F.expr("1") * (F.coalesce(b.try_cast("int"), F.lit(0)) - F.coalesce(a.try_cast("int"), F.lit(0)))).between(0, MOST_PAGES - 1))
    return (
        F.when(pages | low.rlike(CJK_PAGE), "page")
        .when(low.rlike(SECTION), "section")
        .when(low.rlike(DEFINITION), "definition")
        .when(low.rlike(COVERAGE), "coverage")
        .otherwise("semantic")
    )


def route_key(question: Column) -> Column:
    low = F.lower(question)
    page, section = F.regexp_extract(low, PAGE, 1), F.regexp_extract(low, SECTION, 1)
    return F.when(route(question) == "page", F.when(page != "", page).otherwise(F.regexp_extract(low, CJK_PAGE, 1))).when(route(question) == "section", section).otherwise("")


def file_hint(question: Column) -> Column:
    return F.regexp_extract(F.lower(question), FILE, 1)


# Named windows as (days back of the start, days back of the end).
WINDOWS = {"today": (0, 0), "yesterday": (1, 1), "last week": (14, 7), "this week": (7, 0), "last month": (60, 30), "this month": (30, 0), "last year": (730, 365), "this year": (365, 0), "recently": (14, 0), "earlier": (90, 0)}
UNITS = {"day": (1, 1), "week": (7, 1), "month": (30, 15), "year": (365, 15)}


def date_window(phrase: Column, now: Column) -> tuple[Column, Column]:
    """First and last day that a phrase means at ``now``: ISO dates, N units ago (padded), named windows, weekdays."""
    low = F.lower(phrase)
    today = F.to_date(now)
    iso = F.regexp_extract(low, r"(\d{4}-\d{2}-\d{2})", 1)
    count = F.regexp_extract(low, r"\b(\d{1,3})\s+(?:day|week|month|year)s?\s+ago\b", 1)
    unit = F.regexp_extract(low, r"\b\d{1,3}\s+(day|week|month|year)s?\s+ago\b", 1)
    start, end = F.lit(None).cast("date"), F.lit(None).cast("date")
    for i, name in enumerate(("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")):
        # strictly before today: one to seven days back
        back = F.pmod(F.weekday(today) - i - 1, F.lit(7)) + 1
        day = F.date_sub(today, back.cast("int"))
        start, end = F.when(low.rlike(rf"\b{name}\b"), day).otherwise(start), F.when(low.rlike(rf"\b{name}\b"), day).otherwise(end)
    for name, (a, b) in reversed(WINDOWS.items()):
        start, end = F.when(F.contains(low, F.lit(name)), F.date_sub(today, a)).otherwise(start), F.when(F.contains(low, F.lit(name)), F.date_sub(today, b)).otherwise(end)
    for name, (days, pad) in UNITS.items():
        n = F.coalesce(count.try_cast("int"), F.lit(0)) * days
        start, end = F.when(unit == name, F.date_sub(today, n + pad)).otherwise(start), F.when(unit == name, F.date_sub(today, n - pad)).otherwise(end)
    day = F.try_to_date(iso)
    return F.when(iso != "", day).otherwise(start), F.when(iso != "", day).otherwise(end)


def resolved_routes(questions: DataFrame, text: str) -> DataFrame:
    return questions.withColumn("route", route(F.col(text))).withColumn("route_key", route_key(F.col(text))).withColumn("file_hint", file_hint(F.col(text)))

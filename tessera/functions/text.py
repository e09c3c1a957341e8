"""Text expressions: tokens, prefixes, phrases, budgets. All are Column expressions that run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words without weight in a question, own list; English with the commonest German, French and Spanish ones.
STOP_WORDS = (
    "the and for are but not you all any can had her was one our out has him his how its may new now old see two way who did "
    "let say she too use that with have this will your from they know want been good much some time very when come here just "
    "like long make many more only over such take than them well were what where which while would about after again also "
    "because before being between both could does each into most other should since still their then there these those "
    "through under until upon whose why der die das und ist von mit den dem ein eine les des une est que pour dans los las "
    "del por con para"
).split()

WORD = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """All lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def content_tokens(text: Column, stop: tuple[str, ...] | list[str] = STOP_WORDS) -> Column:
    """Tokens of three characters or more that are no stop words."""
    listed = F.array(*map(F.lit, stop))
    return F.filter(tokens(text), lambda t: (F.length(t) >= 3) & ~F.array_contains(listed, t))


#: Words that a query holds at most.
QUERY_WORDS = 12


def question_focus(text: Column) -> Column:
    """The question inside a longer text: what follows the last "question:", else the last sentence that ends in "?"; else empty."""
    labelled = F.trim(F.regexp_extract(text, r"(?is).*question:(.*)$", 1))
    return F.when(labelled != "", labelled).otherwise(F.regexp_extract(text, r"([^.!?\n:]*)\?[^?]*$", 1))


def _original(text: Column, stop: tuple[str, ...] | list[str]) -> Column:
    """Content tokens in their original case."""
    listed = F.array(*map(F.lit, stop))
    return F.filter(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda t: (F.length(t) >= 3) & ~F.array_contains(listed, F.lower(t)))


def query_tokens(text: Column, most: int = QUERY_WORDS) -> Column:
    """Distinct content tokens, at most ``most``.

    If there are more, those that tell the subject stay: first the words of the question inside the text, then names
    and numbers (a capital first letter, a digit), then the others, each tier in order of place.
    """
    held = F.struct(_original(text, STOP_WORDS).alias("words"), F.transform(_original(question_focus(text), STOP_WORDS), F.lower).alias("focus"))

    def chosen(x: Column) -> Column:
        words, focus = x["words"], x["focus"]
        tier = lambda t: F.when(F.array_contains(focus, F.lower(t)), 0).when(t.rlike(r"[0-9]|^\p{Lu}"), 1).otherwise(2)
        order = F.array_sort(F.transform(words, lambda t, i: F.struct(tier(t).alias("tier"), i.alias("i"), F.lower(t).alias("t"))))
        tiered = F.array_distinct(F.transform(order, lambda y: y["t"]))
        return F.when(F.size(words) <= most, F.array_distinct(F.transform(words, F.lower))).otherwise(F.slice(tiered, 1, most))

    # a lambda's variable is worked out once; an expression inside the inner lambdas would be so for every word
    return F.get(F.transform(F.array(held), chosen), F.lit(0))


#: Endings that a prefix search takes off, with the least stem that must stay.
ENDINGS = tuple(sorted("ications ization fulness ousness iveness ations ement ments ities ingly ation ness ment able ible ings ance ence tion sion edly ing ies ous ive ful est ers ion ed er es ly al s".split(), key=lambda e: (-len(e), e)))
LEAST_STEM = 5


def morphological_prefix(token: Column) -> Column:
    """The token without its first matching ending (longest first); null where the stem would be too short."""
    stem = F.lit(None).cast("string")
    for ending in reversed(ENDINGS):
        rest = F.substring(token, F.lit(1), F.length(token) - len(ending))
        stem = F.when(token.endswith(ending), F.when(F.length(token) - len(ending) >= LEAST_STEM, rest)).otherwise(stem)
    return stem


def covers_enough(text: Column, terms: Column, stem: int = 5) -> Column:
    """At least half of the terms (rounded up) occur by their first characters; no terms: true."""
    # the text is folded once for each row, not for each term
    hits = F.get(F.transform(F.array(F.lower(text)), lambda low: F.size(F.filter(terms, lambda t: F.contains(low, F.substring(t, 1, stem))))), F.lit(0))
    return hits >= F.ceil(F.size(terms) / 2)


def collapse(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def shortened(text: Column, most: int) -> Column:
    """At most ``most`` characters, with a mark where something is missing."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def ordinal(n: Column) -> Column:
    last = n % 10
    return F.concat(n.cast("string"), F.when((n % 100).between(11, 13), "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th"))


def human_bytes(n: Column) -> Column:
    """Bytes, kB, MB or GB with one decimal, in powers of 1024."""
    unit = lambda power, name: F.concat(F.format_string("%.1f", n / float(1024**power)), F.lit(f" {name}"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, unit(1, "KB")).when(n < 1024**3, unit(2, "MB")).otherwise(unit(3, "GB"))


def token_estimate(text: Column) -> Column:
    """A quarter of the bytes, and eight for the message itself."""
    return (F.floor(F.octet_length(text) / 4) + 8).cast("long")


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")


def file_extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def quoted_form(text: Column) -> Column:
    """Lower-case words without punctuation, one space apart: the form in which quotations are compared."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def folded(text: Column) -> Column:
    """Typographic variants, white space and case folded: the form in which paragraphs are compared."""
    plain = F.translate(text, "‘’“”–— ", "''\"\"-- ")
    return F.lower(collapse(plain))


def sentences(text: Column) -> Column:
    """Pieces that end in . ! ? ; or an ideographic full stop before white space, or at a line's end; without Markdown marks, trimmed, none empty."""
    plain = lambda line: F.replace(F.replace(F.regexp_replace(F.trim(line), r"^[#>\-*+ |]+", ""), F.lit("**"), F.lit("")), F.lit("`"), F.lit(""))
    cut = lambda line: F.split(F.regexp_replace(plain(line), r"([.!?;。])\s+", "$1\n"), "\n")
    pieces = F.flatten(F.transform(F.split(text, "\r?\n"), cut))
    return F.filter(F.transform(pieces, F.trim), lambda s: F.length(s) > 0)

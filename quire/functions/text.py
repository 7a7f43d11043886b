"""Scalar functions over text columns: everything stays inside the JVM's expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, and the four separators U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f]"
#: Lines that are page furniture (whole line, either case), and titles of front and back matter.
NOISE = r"(\d+|[ivxlc]+|chapter \d+|page \d+ of \d+)"
MATTER = (
    "cover", "copyright", "title page", "half title", "colophon", "dedication", "table of contents", "contents", "brief contents", "toc", "about the author(s)?",
    "about this book", "about the cover", "acknowledg(e)?ments?", "praise for", "front ?matter", "back ?matter", "index", "bibliography", "glossary", "references",
    "credits", "foreword", "preface", "epigraph", "errata", "list of (figures|tables|illustrations)",
)
#: Characters a token, and variables whose values may be shown.
CHARS_PER_TOKEN = 3.8
SHOWN = ("MISTRAL_MODEL", "MISTRAL_API", "MIXTRAL_MODEL", "MIXTRAL_API")


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c evaluated once, however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"(?U){SPACE}+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^{SPACE}+|{SPACE}+$", "")


def _kept_lines(c: Column) -> Column:
    lines = F.transform(F.split(c, r"\R|[\x1c-\x1e]"), lambda x: F.regexp_replace(x, f"(?U){SPACE}+$", ""))
    return F.filter(lines, lambda x: ~x.rlike(f"(?iU)^{SPACE}*{NOISE}{SPACE}*$"))


def _joined(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "-\n(?=[a-z])", ""), "\n{3,}", "\n\n")


def clean_text(c: Column) -> Column:
    """Page text without furniture lines; hyphenated line breaks joined, blank lines thinned, ends stripped; in this order."""
    return strip(_joined(F.array_join(_kept_lines(c), "\n")))


def page_lines(c: Column) -> Column:
    """A page's part of clean_text() of many pages: its kept lines, null if none is. A last carriage return belongs to the break between pages."""
    return once(_kept_lines(F.regexp_replace(c, r"\r\z", "")), lambda kept: F.when(F.size(kept) > 0, F.array_join(kept, "\n")))


def whole_text(pages: Column) -> Column:
    """clean_text() of pages joined by newlines, from their page_lines() in order."""
    return strip(_joined(F.array_join(pages, "\n")))


def page_size(lines: Column) -> Column:
    """What whole_size() needs of a page's page_lines(): blank lines at its ends, the length between, how it begins and ends."""

    def told(all_: Column, body: Column) -> Column:
        lead = F.length(all_) - F.length(F.regexp_replace(all_, r"\A\n+", ""))
        return F.struct(
            F.when(body == "", F.length(all_) + 1).otherwise(lead).alias("lead"), F.when(body == "", F.lit(0)).otherwise(F.length(all_) - lead - F.length(body)).alias("tail"), F.when(body == "", F.lit(-1)).otherwise(F.length(_joined(body))).alias("n"),
            (F.length(body) - F.length(F.regexp_replace(body, rf"(?U)\A{SPACE}+", ""))).alias("indent"), body.rlike(r"\A[a-z]").alias("low"), body.endswith("-").alias("dash"),
        )

    return once(lines, lambda x: F.when(x.isNotNull(), once(F.regexp_replace(x, r"\A\n+|\n+\z", ""), lambda body: told(x, body))))


def whole_size(pages: Column) -> Column:
    """The length of whole_text(), from the pages' page_size() in order: no text is put together."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("gap"), F.lit(False).alias("dash"), F.lit(False).alias("any"))

    def add(a: Column, p: Column) -> Column:
        gap = a["gap"] + p["lead"]
        link = F.when(~a["any"], -p["indent"]).when(gap > 0, F.lit(2)).when(a["dash"] & p["low"], F.lit(-1)).otherwise(F.lit(1))
        body = F.struct((a["n"] + link + p["n"]).cast("long").alias("n"), p["tail"].alias("gap"), p["dash"].alias("dash"), F.lit(True).alias("any"))
        return F.when(p["n"] < 0, F.struct(a["n"].alias("n"), gap.alias("gap"), a["dash"].alias("dash"), a["any"].alias("any"))).otherwise(body)

    return F.aggregate(pages, start, add, lambda a: a["n"])


def is_front_matter(c: Column) -> Column:
    return c.rlike(f"(?iU)^{SPACE}*({'|'.join(MATTER)}){SPACE}*$")


def words(c: Column) -> Column:
    """Runs of a-z and 0-9 in the lowered text."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))


def est_tokens(c: Column) -> Column:
    return (F.length(c) / F.lit(CHARS_PER_TOKEN)).cast("int")


def slug(c: Column) -> Column:
    dashed = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 48)


def cache_key(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 32)


def grams(ws: Column, n: int) -> Column:
    return F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(1), F.size(ws) - (n - 1)), lambda i: F.array_join(F.slice(ws, i, n), " "))).otherwise(F.array().cast("array<string>"))


def leaks_title(question: Column, title: Column, least: int = 4) -> Column:
    """Does a run of `least` words of the title stand in the question? Never for shorter titles."""
    return F.coalesce(F.arrays_overlap(grams(words(question), least), grams(words(title), least)), F.lit(False))


def parse_questions(raw: Column, n: int | Column) -> Column:
    """The first n questions of a model's answer: the JSON array in it if it has any strings, else its lines that end with '?', bullets and quotes cut."""
    n = F.lit(n) if isinstance(n, int) else n
    items = F.from_json(F.regexp_extract(raw, r"(?s)\[.*\]", 0), "array<string>")
    told = F.filter(F.transform(items, strip), lambda x: x != "")
    bullets = r'^\s*(?:[-*\d.)\]]+\s*)|^\s*"|"\s*,?\s*$'
    lines = F.filter(F.transform(F.split(raw, r"\R"), lambda x: strip(F.regexp_replace(x, bullets, ""))), lambda x: x.endswith("?"))
    return F.slice(F.when(F.size(told) > 0, told).otherwise(lines), F.lit(1), n)


def redact(name: Column, value: Column) -> Column:
    return F.when(name.isin(*SHOWN), F.concat(name, F.lit("="), value)).otherwise(F.concat(name, F.lit("=<redacted len="), F.length(strip(value)).cast("string"), F.lit(">")))


def recall_at(ranked: Column, gold: Column, k: int) -> Column:
    return F.coalesce(F.array_contains(F.slice(ranked, 1, k), gold), F.lit(False)).cast("double")


def ndcg_at(ranked: Column, gold: Column, k: int) -> Column:
    at = F.coalesce(F.array_position(F.slice(ranked, 1, k), gold), F.lit(0))
    return F.when(at > 0, 1 / F.log2(at + F.lit(1.0))).otherwise(0.0)

"""Rules on text, names and paths as column expressions; no Python runs on the executors."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.constants import INVALID, ANSWER_FIELDS, CATEGORIES, MONTHS, NO_VALUE

NUMERIC_DATES = (r"\d{1,2}\.\d{1,2}\.\d{2,4}", r"\d{1,2}/\d{1,2}/\d{2,4}", r"\d{4}-\d{1,2}-\d{1,2}")
WRITTEN_DATE = rf"(?iu)\d{{1,2}}\.\s*(?:{'|'.join(MONTHS)})\s*\d{{4}}"


def _all(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), month.cast("string"), day.cast("string")), F.lit("yyyy-M-d")).cast("date")


def numeric_dates(text: Column) -> Column:
    """All plausible dates in digits: day first with dots or slashes, or year first with hyphens."""

    def read(found: Column) -> Column:
        iso = F.contains(found, F.lit("-"))

        def day_of(parts: Column) -> Column:
            year, month, day = F.when(iso, parts[0]).otherwise(parts[2]), parts[1], F.when(iso, parts[2]).otherwise(parts[0])
            year = F.when(year >= 100, year).when(year < 50, year + 2000).otherwise(year + 1900)
            return F.when(day.between(1, 31) & month.between(1, 12) & year.between(1990, 2100), _date(year, month, day))

        return once(F.transform(F.split(found, "[./-]"), lambda p: p.cast("int")), day_of)

    return F.array_compact(F.transform(F.concat(*[_all(text, p) for p in NUMERIC_DATES]), read))


def written_dates(text: Column) -> Column:
    """All dates with a German month name."""
    numbers = F.map_from_arrays(F.array(*[F.lit(m) for m in MONTHS]), F.array(*[F.lit(i + 1) for i in range(12)]))

    def read(found: Column) -> Column:
        name = F.lower(F.regexp_extract(found, r"(?U)\.\s*(\p{L}+)", 1))
        year = F.regexp_extract(found, r"(\d{4})$", 1).cast("int")
        return F.when(year > 0, _date(year, numbers[name], F.regexp_extract(found, r"^(\d{1,2})", 1).cast("int")))

    return F.array_compact(F.transform(_all(text, WRITTEN_DATE), read))


def dates(text: Column) -> Column:
    """Distinct dates, newest first."""
    return F.sort_array(F.array_distinct(F.concat(numeric_dates(text), written_dates(text))), asc=False)


def categories(text: Column) -> Column:
    """Names of the categories one of whose marks is in the text, in their order."""
    some = lambda low, marks: F.greatest(*[low.contains(m).cast("int") for m in marks], F.lit(0)).cast("boolean")
    return once(F.lower(text), lambda low: F.array_compact(F.array(*[F.when(low.isNotNull() & some(low, marks), F.lit(name)) for name, marks in CATEGORIES.items()])))


_NAME = r"[A-ZÄÖÜ][a-zäöüß]+(?:\s+[A-ZÄÖÜ][a-zäöüß]+)*"


def company(text: Column) -> Column:
    """A name before a legal form, else after a word like Firma; null if none of fitting length."""
    found = [F.trim(F.regexp_extract(text, p, 1)) for p in (rf"({_NAME})\s+(?:GmbH|AG|KG|OHG|e\.V\.|Ltd\.?)", rf"(?:Firma|Company|Von|From)[\s:]+({_NAME})")]
    return F.coalesce(*[once(f, lambda name: F.when(F.length(name).between(3, 49), name)) for f in found])


def capitalised(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 20)))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def suggested_name(text: Column, filename: Column, first_category: Column | None = None, newest: Column | None = None) -> Column:
    """Category, company and month of the newest date; else the date that leads the file name, and Dokument."""
    kind = F.get(categories(text), F.lit(0)) if first_category is None else first_category
    day = F.get(dates(text), F.lit(0)) if newest is None else newest
    made = once(F.concat_ws(" ", once(kind, capitalised), company(text), F.date_format(day, "yyyy-MM")), lambda name: F.nullif(name, F.lit("")))
    leading = F.nullif(F.regexp_extract(filename, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    return F.regexp_replace(F.coalesce(made, F.concat_ws(" ", leading, F.lit("Dokument"))), r'[<>:"/\\|?*]', "")


def sanitised(name: Column) -> Column:
    """A safe PDF name of at most 84 characters."""
    out = F.regexp_replace(name, r'[<>:"/\\|?*]', "_")
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"), ("ß", "ss"), (" ", "_")):
        out = F.replace(out, F.lit(a), F.lit(b))
    out = with_pdf(out)
    return F.when(F.length(out) > 84, F.concat(F.substring(out, 1, 80), F.lit(".pdf"))).otherwise(out)


def with_pdf(name: Column) -> Column:
    return once(name, lambda n: F.when(F.lower(n).endswith(".pdf"), n).otherwise(F.concat(n, F.lit(".pdf"))))


def truncated(text: Column, limit: int) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit), F.lit("\n[... Text gekürzt ...]")))


def human_size(n_bytes: Column) -> Column:
    """1024-based size with one decimal; exact ties go to the even digit."""
    out = None
    for i, unit in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB"]))):
        shown = F.format_string("%.1f %s", F.bround(n_bytes / float(1024**i), 1), F.lit(unit))
        out = shown if out is None else F.when(n_bytes < float(1024 ** (i + 1)), shown).otherwise(out)
    return out


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """All before the last slash; `/` for a path directly below it."""
    return F.when(path.rlike("^/[^/]*$"), "/").otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def suffix(path: Column) -> Column:
    """The last dot of the name and what follows it; none where the dot leads or ends the name."""
    return F.regexp_extract(basename(path), r".(\.[^.]+)$", 1)


def year_in(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"20\d{2}", 0), F.lit(""))


def number_in_stem(name: Column) -> Column:
    return F.nullif(F.regexp_extract(stem(name), r"\d{3,}", 0), F.lit(""))


def tax_year(date_text: Column) -> Column:
    return F.nullif(F.regexp_extract(date_text, r"^\d{4}", 0), F.lit(""))


def title_of(name: Column) -> Column:
    return F.translate(stem(name), "_-", "  ")


def without_fences(answer: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(answer), r"^```[^\n]*\n", ""), r"\n?```\s*$", "")


def short_path(path: Column) -> Column:
    return F.when(F.length(path) > 50, F.concat(F.lit("..."), F.substring(path, -47, 47))).otherwise(path)


def short_name(name: Column) -> Column:
    """A name for a narrow place: at most 25 characters."""
    return F.when(F.length(name) > 25, F.concat(F.substring(name, 1, 22), F.lit("..."))).otherwise(name)


def cached_list(json: Column) -> Column:
    """A list of strings as a cache holds it; empty where it is missing or no such list."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def cached_suggestions(json: Column) -> Column:
    """Suggestions as a cache holds them, without those that aren't whole; empty where it is missing or broken."""
    read = F.from_json(json, "array<struct<folder_path: string, folder_name: string, confidence: double, reason: string>>")
    return F.coalesce(F.filter(read, lambda x: x["folder_path"].isNotNull() & x["confidence"].isNotNull()), F.filter(F.from_json(F.lit("[]"), "array<struct<folder_path: string, folder_name: string, confidence: double, reason: string>>"), lambda x: F.lit(True)))


def percent(confidence: Column) -> Column:
    """Whole percent, cut off."""
    return F.floor(confidence.cast("double") * 100).cast("int")


def answer_field(answer: Column, mark: str, any_word: bool = False) -> Column:
    """The value of the last line that starts with the mark and has a value; with any_word, words that stand for no value count too."""
    lines = F.filter(F.transform(F.split(F.trim(answer), "\n"), lambda x: F.trim(x)), lambda x: x.startswith(mark))
    values = F.transform(lines, lambda x: F.trim(F.substring(x, len(mark) + 1, 1 << 20)))
    return F.try_element_at(values if any_word else F.filter(values, lambda v: ~F.upper(v).isin(NO_VALUE)), F.lit(-1))


def answer_confidence(answer: Column) -> Column:
    """The share after KONFIDENZ: 0 without such a line, one half if it is no number."""
    lines = F.filter(F.transform(F.split(F.trim(answer), "\n"), lambda x: F.trim(x)), lambda x: x.startswith("KONFIDENZ:"))
    value = F.trim(F.replace(F.substring(F.element_at(lines, -1), 11, 1 << 20), F.lit("%"), F.lit("")))
    return F.when(F.size(lines) == 0, 0.0).otherwise(F.coalesce(value.try_cast("double") / 100, F.lit(0.5)))


def answer_metadata(answer: Column) -> Column:
    """Metadata of an answer as a map of the fields that have a value."""
    pairs = [x for mark, key in ANSWER_FIELDS.items() for x in (F.lit(key), answer_field(answer, mark))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def classification_prompt(text: Column, folders: Column, limit: int = 1500) -> Column:
    return F.concat(F.lit("Ordner:\n"), F.concat_ws("\n", F.transform(folders, lambda f: F.concat(F.lit("- "), f))), F.lit("\n\nText:\n"), truncated(F.coalesce(text, F.lit("")), limit))


def without_invalid(name: Column) -> Column:
    """A user's name without the characters that no name may hold."""
    return F.translate(name, INVALID, "")


def mtime_day(seconds: Column) -> Column:
    """The day of a time in seconds, in the session's time zone."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def _folding() -> dict[str, str]:
    """Letters of Latin-1, Latin Extended-A and B and Extended Additional that decompose, with the letter they begin with."""
    letters = (chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)))
    return {c: base for c in letters if c == c.lower() and (base := unicodedata.normalize("NFD", c)[0]) != c}


FOLDED = _folding()
#: Combining marks go before tokens are cut.
MARKS = "[\u0300-\u036f]"


def folded(text: str) -> str:
    """The same for a Python string: lower case, without accents and combining marks."""
    return re.sub(MARKS, "", text.lower().translate(str.maketrans(FOLDED)))


def folded_tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case without accents; plain ASCII, which has none, isn't folded."""
    low = F.lower(text)
    plain = F.regexp_replace(F.translate(low, "".join(FOLDED), "".join(FOLDED.values())), MARKS, "")
    return _all(F.when(F.octet_length(low) == F.char_length(low), low).otherwise(plain), r"[\p{L}\p{N}]+")

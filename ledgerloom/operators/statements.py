"""Statement text to transactions: lines, headers and footers, sections, entries, amounts.

The line-by-line reading of a statement is a set of windows: sections and dates are carried forward by last(), entries
are numbered by running sums. A document is one partition; documents are small and many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.text import any_of, contains_any, lines_of, masked
from ..runtime import let
from .classify import cascade

EDGE_LINES = 4


def page_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, line_no, line of pages (doc_id, page_no, text): collapsed, not blank."""
    return pages.select("doc_id", "page_no", F.posexplode(lines_of(F.coalesce("text", F.lit("")))).alias("line_no", "line"))


def is_noise() -> Column:
    return F.col("line").rlike(rf"(?iu)\b(?:{any_of(R.LINE_NOISE)})\b")


def without_headers(lines: DataFrame, double_count: bool = True) -> DataFrame:
    """lines without noise and without headers and footers: keys (digits masked) that stand twice or more among the
    first and last four lines of a document's pages.

    On a page of fewer than eight lines the two ends overlap, and with ``double_count`` a line in both counts twice.
    """
    rows = lines.withColumn("key", masked(F.col("line")))
    page = Window.partitionBy("doc_id", "page_no")
    rows = rows.withColumns({"up": F.row_number().over(page.orderBy("line_no")), "down": F.row_number().over(page.orderBy(F.col("line_no").desc()))})
    top, bottom = (F.col("up") <= EDGE_LINES).cast("int"), (F.col("down") <= EDGE_LINES).cast("int")
    times = top + bottom if double_count else F.greatest(top, bottom)
    counts = rows.filter((F.col("up") <= EDGE_LINES) | (F.col("down") <= EDGE_LINES)).groupBy("doc_id", "key").agg(F.sum(times).alias("n")).filter("n >= 2")
    return rows.join(counts, ["doc_id", "key"], "left_anti").filter(~is_noise()).select("doc_id", "page_no", "line_no", "line")


def section_of(line: Column) -> Column:
    upper = F.upper(line)
    return F.when(contains_any(upper, R.BLOCKED_HEADERS), "blocked_amounts").when(contains_any(upper, [*R.TABLE_HEADERS, *R.BOOKED_HEADERS]), "booked_transactions")


def candidates(lines: DataFrame) -> DataFrame:
    """doc_id, candidate (from 1), section, text: the entries of each document, in order, pages end to end."""
    upper = F.upper("line")
    doc = Window.partitionBy("doc_id").orderBy("page_no", "line_no")
    so_far = doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    noisy = contains_any(upper, R.DATED_NOISE)
    dated = F.col("line").rlike(R.DATE_START)
    rows = lines.withColumns({"header": section_of(F.col("line")), "dated": dated, "noisy": noisy})
    # Before any header, the first dated line that is no noise opens the booked section.
    opens = (F.count("header").over(so_far) == 0) & F.col("dated") & ~F.col("noisy")
    rows = rows.withColumn("event", F.coalesce("header", F.when(opens, "booked_transactions")))
    rows = rows.withColumns(
        {
            "section": F.last("event", ignorenulls=True).over(so_far),
            "run": F.count("header").over(so_far),
            "blocked_run": F.count_if(F.col("header") == "blocked_amounts").over(so_far),
        }
    ).filter("header is null and section is not null")
    upper = F.upper("line")
    dash = F.trim("line").startswith("-") & upper.contains(R.BLOCKED_ENTRY) & F.col("line").rlike(R.DATE)
    boundary = F.when(F.col("section") == "blocked_amounts", dash).otherwise(F.upper(F.trim("line")).rlike(f"^(?:{any_of(R.ENTRY_STARTS)})"))
    start = F.col("dated") | F.coalesce(boundary, F.lit(False))
    rows = rows.withColumn("start", start).filter(~(F.col("start") & F.col("noisy")))
    by_run = Window.partitionBy("doc_id", "run").orderBy("page_no", "line_no")
    by_blocked = Window.partitionBy("doc_id", "blocked_run").orderBy("page_no", "line_no")
    rows = rows.withColumns(
        {
            "entry": F.count_if("start").over(by_run.rowsBetween(Window.unboundedPreceding, 0)),
            "carried": F.last(F.when(F.col("dated"), F.substring("line", 1, 10)), ignorenulls=True).over(by_blocked.rowsBetween(Window.unboundedPreceding, -1)),
        }
    ).filter("entry > 0")
    prefixed = F.when(F.col("start") & ~F.col("dated") & F.col("carried").isNotNull() & ~F.col("line").rlike(R.DATE), F.concat_ws(" ", "carried", "line")).otherwise(F.col("line"))
    parts = F.array_sort(F.collect_list(F.struct("page_no", "line_no", prefixed.alias("t"))))
    joined = rows.groupBy("doc_id", "run", "entry").agg(F.first("section").alias("section"), F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("text"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("run", "entry"))
    return joined.select("doc_id", number.alias("candidate"), "section", "text")


def amount_value(text: Column) -> Column:
    """A number written with points and commas: the last of both is the decimal mark, a lone comma before three
    digits groups thousands; what is no number then is null."""
    comma, dot = text.contains(","), text.contains(".")
    last = lambda c: F.length(text) - F.locate(c, F.reverse(text))
    both = F.when(last(",") > last("."), F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(text, F.lit(","), F.lit("")))
    thousands = text.rlike(r"^[^,]*,[^,]{3}$")
    only = F.when(thousands, F.replace(text, F.lit(","), F.lit(""))).otherwise(F.replace(text, F.lit(","), F.lit(".")))
    return F.when(comma & dot, both).when(comma, only).otherwise(text).try_cast("double")


def amount_and_direction(text: Column, section: Column) -> Column:
    """A struct of amount and direction; a null amount rejects the entry."""
    return let(text, lambda t: _amount_and_direction(t, section))


def _amount_and_direction(text: Column, section: Column) -> Column:
    first = lambda t: F.nullif(F.regexp_extract(t, f"({R.AMOUNT})", 1), F.lit(""))
    after = lambda words: F.nullif(F.regexp_extract(text, rf"(?iu)\b(?:{words})\b[^\d+-]{{0,12}}({R.AMOUNT})", 1), F.lit(""))
    debit, credit = amount_value(after("DEBIT|DB")), amount_value(after("CREDIT|CR"))
    open_ = first(F.regexp_replace(text, r"(?isu)\b(?:SOLD|BALANCE)\b.*$", ""))
    value = amount_value(open_)
    steps = [
        (section == "blocked_amounts", {"amount": F.abs(amount_value(first(text))), "direction": "debit"}),
        (debit.isNotNull(), {"amount": F.abs(debit), "direction": "debit"}),
        (credit.isNotNull(), {"amount": F.abs(credit), "direction": "credit"}),
        (open_.startswith("+"), {"amount": F.abs(value), "direction": "credit"}),
        (open_.startswith("-"), {"amount": F.abs(value), "direction": "debit"}),
        (contains_any(F.upper(text), R.CREDIT_WORDS), {"amount": F.abs(value), "direction": "credit"}),
    ]
    return cascade(steps, {"amount": F.abs(value), "direction": "debit"}, {"amount": "double", "direction": "string"})


def description(text: Column, date: Column) -> Column:
    """text without the first place of the date, collapsed, without marks at the ends."""
    place = F.position(date, text)
    rest = F.concat(F.substring(text, F.lit(1), place - 1), F.lit(" "), F.substring(text, place + F.length(date), F.length(text)))
    return F.trim(F.regexp_replace(rest, r"(?U)\s+", " "), F.lit(" -:;"))


def transaction_id(number: Column, date: Column, amount: Column, direction: Column, text: Column, section: Column) -> Column:
    """TXN, the number in six digits or more, and ten hex digits of a hash of the entry."""
    whole = F.concat_ws("|", number.cast("string"), date, F.format_string("%.2f", amount), direction, text, section)
    digits = F.lpad(number.cast("string"), 6, "0")
    return F.concat(F.lit("TXN-"), F.when(number > 999999, number.cast("string")).otherwise(digits), F.lit("-"), F.substring(F.sha1(whole), 1, 10))


def parse_candidates(entries: DataFrame) -> DataFrame:
    """The seven required columns, doc_id and seq of the entries with a date and an amount."""
    rows = entries.withColumn("booking_date", F.nullif(F.regexp_extract("text", R.DATE, 1), F.lit(""))).filter("booking_date is not null")
    rows = rows.withColumn("__a", amount_and_direction(F.col("text"), F.col("section"))).filter("__a.amount is not null")
    rows = rows.withColumns({"currency": F.coalesce(F.nullif(F.upper(F.regexp_extract("text", f"(?iu){R.CURRENCY}", 1)), F.lit("")), F.lit("RON")), "raw_description": description(F.col("text"), F.col("booking_date"))})
    key = transaction_id(F.col("candidate"), F.col("booking_date"), F.col("__a.amount"), F.col("__a.direction"), F.col("raw_description"), F.col("section"))
    return rows.select("doc_id", F.col("candidate").alias("seq"), key.alias("transaction_id"), "booking_date", F.col("__a.amount").alias("amount"), "currency", F.col("__a.direction").alias("direction"), "raw_description", F.col("section").alias("source_section"))


def parse_statements(pages: DataFrame) -> DataFrame:
    return parse_candidates(candidates(without_headers(page_lines(pages))))

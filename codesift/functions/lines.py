"""Column expressions over text: match lines, line windows, trimming.

All built from Spark's own functions so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "\u0001"  # inserted before each match start; never left in the input
STEPPED = "\u0003"  # ends a match; no rule's match starts with it
SUBST = "\u0002"  # the input's own U+0001 become this (same class for every rule)



def safe_text(text: Column) -> Column:
    """Input text with U+0001 replaced; no rule tells U+0001 and U+0002 apart."""
    return F.translate(text, MARK, SUBST)


def mark_matches(text: Column, java_pattern: str, java_skip: str | None = None) -> Column:
    """`text` with a mark before each match.

    One linear pass of the rule's regex (a real find loop: matches are
    non-overlapping, left to right, over the whole text). Runs of `java_skip`
    are stepped over: they get an empty pair of marks, which is taken out.
    """
    if java_skip is None:
        return F.regexp_replace(text, F.lit(java_pattern), F.lit(MARK + "$0"))
    either = F.regexp_replace(text, F.lit(f"({java_pattern})|({java_skip})"), F.lit(f"{MARK}$1{STEPPED}$2"))
    return F.replace(either, F.lit(MARK + STEPPED), F.lit(""))


def strip_to_skeleton(marked: Column) -> Column:
    """Newlines and match marks of a marked text, everything else dropped."""
    return F.regexp_replace(marked, F.lit(f"[^\n{MARK}]+"), F.lit(""))


def match_skeleton(text: Column, java_pattern: str, java_skip: str | None = None) -> Column:
    """Newlines and match marks of `text`."""
    return strip_to_skeleton(mark_matches(text, java_pattern, java_skip))


def line_skeleton(marked: Column) -> Column:
    """The skeleton of a text with marks, at least up to its last mark; one mark (the common case) needs no regex."""
    head = F.substring_index(marked, MARK, 1)
    one = F.octet_length(marked) - F.octet_length(F.replace(marked, F.lit(MARK), F.lit(""))) == 1
    breaks = F.octet_length(head) - F.octet_length(F.replace(head, F.lit("\n"), F.lit("")))
    return F.when(one, F.concat(F.repeat(F.lit("\n"), breaks), F.lit(MARK))).otherwise(strip_to_skeleton(marked))


def once(value: Column, use) -> Column:
    """`use(value)` with `value` computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), 0)


LINE_BITS = 32


def skeleton_codes_sql(column: str, tag: int) -> str:
    """SQL text: distinct match lines of one rule, encoded `tag << 32 | line`, ascending.

    Line of a match = newlines before its start + 1. In the skeleton the
    prefix before the k-th mark holds k-1 marks and the newlines, so
    line_k = length(prefix_k) - k + 2. One mark (the common case) needs no
    lambda; several marks take one lambda call per mark, never per line.
    SQL text keeps plan building cheap: one parse for all rules instead of
    hundreds of calls into the JVM for each.
    """
    off, mark = tag << LINE_BITS, "chr(1)"
    n_marks = f"(octet_length({column}) - octet_length(replace({column}, {mark}, '')))"
    one = f"array(CAST(octet_length(substring_index({column}, {mark}, 1)) + {off + 1}L AS BIGINT))"
    many = (f"array_distinct(transform(sequence(1, {n_marks}), k -> "
            f"CAST(length(substring_index({column}, {mark}, k)) - k + {off + 2}L AS BIGINT)))")
    return (f"CASE WHEN {column} IS NULL OR {column} = '' OR {n_marks} = 0 THEN CAST(array() AS ARRAY<BIGINT>) "
            f"WHEN {n_marks} = 1 THEN {one} ELSE {many} END")


def decode_rule(code: Column) -> Column:
    return F.shiftright(code, LINE_BITS).cast("int")


def decode_line(code: Column) -> Column:
    return code.bitwiseAND(F.lit((1 << LINE_BITS) - 1)).cast("int")


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_window(lines: Column, line: Column, before: int = 4, after: int = 5) -> Column:
    """Lines `line-before .. line+after` (1-based, clipped), joined by newline."""
    start = F.greatest(F.lit(1), line - before)
    stop = F.least(F.size(lines), line + after)
    length = F.greatest(F.lit(0), stop - start + 1)
    return F.array_join(F.slice(lines, start, length), "\n")


# JavaScript's white space and line terminators.
JS_BLANKS = ("\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
             + "\u2028\u2029\u202f\u205f\u3000\ufeff")


def js_trim(text: Column) -> Column:
    """Trim JavaScript whitespace and line terminators from both ends (one linear pass)."""
    return F.btrim(text, F.lit(JS_BLANKS))


def js_length(text: Column) -> Column:
    """Length in UTF-16 code units, as JavaScript counts (astral characters count 2)."""
    return (F.length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def js_prefix(text: Column, n: int) -> Column:
    """First `n` UTF-16 code units (JavaScript `substring(0, n)`); cheap on long texts."""
    head = F.substring(text, 1, n)  # n code points cover at least n units
    return F.decode(F.substring(F.encode(head, "UTF-16BE"), 1, 2 * n), "UTF-16BE")

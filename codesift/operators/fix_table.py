"""Fixes from a table (F4-F8): an outside list of edits applied to a table of texts.

A fix row names a text by its ids, a line, and an edit:

    fix_id, fix_type (REPLACE, DELETE, INSERT), line, find, find_kind (literal or regex), replace,
    insert_at, insert_content, requires_confirmation, seq

Columns that the table lacks count as null. A null `find_kind` is a regex in Java's syntax, `(?i)` and other flags
inside it; a literal is searched for as it is. A replacement follows JavaScript: `$1` to `$9` are groups (left as they
stand where the pattern has no such group), `$&` the match, `` $` `` and `$'` what is before and after it, `$$` a `$`.
Only the first match on the line is replaced. A regex that cannot be compiled ends the job.

All fixes refer to the original line numbers, so the order of lines makes no difference; a line below 1 means line 1.
The fixes of one line run by (seq, fix_id): each REPLACE works on what the one before left, a DELETE removes the line
and its break whatever else stands there, INSERT puts its content above (`ABOVE`) or below the line and stays even if
the line goes. Every fix gets a status:

    applied          the text was edited
    unchanged        a REPLACE found nothing, or put back the same
    overridden       a REPLACE on a line that a DELETE removes
    out_of_range     the text has no such line
    incomplete       no line; a REPLACE without `find`; an INSERT without content
    refused          MULTI_FILE, or a type that is not known
    not_approved     it requires confirmation and its (ids, fix_id) is not among the approved ones
    no_text          no text has these ids

How it runs: fixes, approvals and the texts' line counts (a few numbers a text) go by ids through one shuffle, the only
one of the fixes. Out of it each fix gets its status, so that what is gathered for a text is bounded by its own lines. The
texts are shuffled once, or not at all if they lie by ids already; one pass over a text's lines rebuilds it. Fixes of a hot
text are sorted by one task, which may spill, and folded line by line before they meet it. Rows of fixes with equal
(ids, fix_id) are one fix, the first in the order of their other columns; texts with equal ids each get the fixes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lines import once, split_lines

#: Columns of a fix besides the ids, with their types.
FIX_FIELDS = {
    "fix_id": "string", "fix_type": "string", "line": "int", "find": "string", "find_kind": "string",
    "replace": "string", "insert_at": "string", "insert_content": "string", "requires_confirmation": "boolean",
    "seq": "bigint",
}
STATUSES = ["applied", "unchanged", "overridden", "out_of_range", "incomplete", "refused", "not_approved", "no_text"]


class Applied(NamedTuple):
    """`texts`: (columns of the texts..., code_fixed, n_applied); `statuses`: (ids..., fix_id, line, fix_type, status, applied)."""

    texts: DataFrame
    statuses: DataFrame


def _gathered(texts: DataFrame, fixes: DataFrame, approved: DataFrame | None, text_col: str, ids: Sequence[str]) -> DataFrame:
    """One row for each (ids, fix_id) of the fixes: FIX_FIELDS, `_approved`, and `_lines`, the most lines of a text of these ids.

    Fixes, approvals and the texts' line counts go through one shuffle by ids, which holds for all that follows.
    """
    have = {c.lower() for c in fixes.columns}
    fields = {c: (F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in FIX_FIELDS.items()}
    null = {c: F.lit(None).cast(t).alias(c) for c, t in FIX_FIELDS.items()}
    others = [c for c in FIX_FIELDS if c != "fix_id"]
    words, numbers = ([c for c in others if (FIX_FIELDS[c] == "string") == is_word] for is_word in (True, False))

    def row(table, words_of, of, yes=None, n=None):
        # What repeats from row to row comes first and in one piece: a sixth less to shuffle than as columns of their own.
        last = F.lit(yes).cast("boolean").alias("_yes"), (F.lit(None) if n is None else n).cast("int").alias("_n")
        return table.select(words_of.alias("_words"), *ids, *(of[c] for c in numbers), of["fix_id"], *last)

    no_words = F.lit(None).cast(f"struct<{','.join(f'{c}:string' for c in words)}>")
    rows = row(fixes, F.struct(*(fields[c] for c in words)), fields).union(
        row(texts, no_words, null, n=F.size(split_lines(F.coalesce(text_col, F.lit(""))))))
    if approved is not None:
        rows = rows.union(row(approved, no_words, null | {"fix_id": F.col("fix_id").cast("string")}, yes=True))
    edit = F.when(F.col("_words").isNotNull(), F.struct(*(F.col(f"_words.{c}" if c in words else c).alias(c) for c in others)))
    # Sorted once, by (ids, fix_id); nothing is sorted before the shuffle.
    one = rows.repartition(*ids).groupBy(*ids, "fix_id").agg(F.min(edit).alias("_f"), F.max("_yes").alias("_yes"), F.max("_n").alias("_n"))
    known = one.withColumn("_lines", F.max("_n").over(Window.partitionBy(*ids))).where("_f IS NOT NULL")
    own = [F.col(c).cast(t).alias(c) for c, (_, t) in zip(ids, fixes.select(*ids).dtypes)]
    return known.select(*own, "fix_id", "_f.*", F.coalesce("_yes", F.lit(False)).alias("_approved"), "_lines")


def expand_replacement(replace: Column, groups: Column, before: Column, match: Column, after: Column) -> Column:
    """A JavaScript replacement string filled in; `groups` is the array of the match's groups (null: did not take part)."""
    parts = F.regexp_extract_all(replace, F.lit(r"(\$[0-9$&`']|\$|[^$]+)"), 1)

    def one(p):
        digit = F.substring(p, 2, 1).try_cast("int")
        group = F.when(digit.between(1, F.size(groups)), F.coalesce(F.try_element_at(groups, F.greatest(digit, F.lit(1))), F.lit("")))
        dollar = (
            F.when(p == "$$", F.lit("$")).when(p == "$&", match).when(p == "$`", before).when(p == "$'", after)
            .when(group.isNotNull(), group).otherwise(p)
        )
        return F.when(p.startswith("$"), dollar).otherwise(p)

    return F.array_join(F.transform(parts, one), "")


def n_groups(pattern: Column) -> Column:
    """Capturing groups of a Java pattern: opening brackets that are neither escaped, in a class, nor special."""
    plain = F.regexp_replace(F.regexp_replace(pattern, r"(?s)\\Q.*?(\\E|\z)|\\.", "_"), r"\[[^\]]*\]", "_")
    return F.regexp_count(plain, F.lit(r"\((?!\?)|\(\?<(?![=!])"))


def _group(text: Column, pattern: Column, i: int) -> Column:
    return F.call_function("regexp_extract", text, pattern, F.lit(i))  # the pattern is a column


def replace_first(text: Column, fix: Column) -> Column:
    """the line with the fix's first match replaced; the line itself if nothing is found."""
    find, rep = fix["find"], F.coalesce(fix["replace"], F.lit(""))
    literal = F.coalesce(fix["find_kind"], F.lit("regex")) == "literal"
    place = F.when(literal, F.instr(text, find)).otherwise(F.regexp_instr(text, find))
    # Nine more empty groups, so that asking for a group that the pattern lacks is no error
    padded = F.concat(find, F.lit("()" * 9))
    none = F.array().cast("array<string>")
    groups = F.when(literal | ~rep.rlike(r"\$[1-9]"), none).otherwise(
        F.slice(F.array(*(_group(text, padded, i) for i in range(1, 10))), F.lit(1), F.least(n_groups(find), F.lit(9))))

    def around(at):
        # a regex's place counts UTF-16 units, a literal's code points
        before = F.when(literal, F.substring(text, F.lit(1), at - 1)).otherwise(
            F.decode(F.substring(F.encode(text, "UTF-16BE"), F.lit(1), 2 * (at - 1)), "UTF-16BE"))
        match = F.when(literal, find).otherwise(_group(text, find, 0))
        return F.struct(before.alias("before"), match.alias("match"), groups.alias("groups"))

    def done(x):
        before, match = x["before"], x["match"]
        after = F.substring(text, F.char_length(before) + F.char_length(match) + 1, F.char_length(text))
        filled = lambda y: F.concat(before, expand_replacement(rep, x["groups"], before, match, y), y)
        return once(after, filled)

    return once(place, lambda at: F.when(at > 0, once(around(at), done)).otherwise(text))


def _line_edit(line: Column, fixes: Column) -> Column:
    """The lines that stand in a line's place and the status of each of its fixes, in order."""
    deleted = F.exists(fixes, lambda f: f["fix_type"] == "DELETE")
    start = F.struct(line.alias("text"), F.array().cast("array<string>").alias("status"))

    def step(acc, f):
        def edited(new):
            status = (
                F.when(f["fix_type"] != "REPLACE", "applied").when(deleted, "overridden")
                .when(new == acc["text"], "unchanged").otherwise("applied")
            )
            return F.struct(new.alias("text"), F.concat(acc["status"], F.array(status)).alias("status"))

        return once(F.when(f["fix_type"] == "REPLACE", replace_first(acc["text"], f)).otherwise(acc["text"]), edited)

    folded = F.aggregate(fixes, start, step)
    inserted = F.filter(fixes, lambda f: f["fix_type"] == "INSERT")
    above = lambda f: F.coalesce(f["insert_at"], F.lit("")) == "ABOVE"
    up = F.transform(F.filter(inserted, above), lambda f: f["insert_content"])
    down = F.transform(F.filter(inserted, lambda f: ~above(f)), lambda f: f["insert_content"])

    def put(x):
        body = F.when(deleted, F.array().cast("array<string>")).otherwise(F.array(x["text"]))
        return F.struct(F.concat(up, body, down).alias("lines"), x["status"].alias("status"))

    return once(folded, put)


def _rebuilt(lines: Column, edits: Column) -> Column:
    """The text: between the edited lines, in order, what stands there; one slice an edit, so linear in the lines."""
    def piece(e, i):
        last = F.when(i > 0, F.get(edits, i - 1)["at"]).otherwise(F.lit(0))
        return F.concat(F.slice(lines, last + 1, e["at"] - last - 1), e["new"]["lines"])

    end = F.element_at(edits, -1)["at"]
    tail = F.slice(lines, end + 1, F.size(lines) - end)
    return F.array_join(F.concat(F.flatten(F.transform(edits, piece)), tail), "\n")


def _met(texts: DataFrame, fixes: DataFrame, approved: DataFrame | None, text_col: str, ids: Sequence[str],
         same: Callable[[Column, Column], Column]) -> tuple[DataFrame, DataFrame]:
    """The texts with `_edits`, the fixes of each line; and the fixes with `at` and `status`, null where the edit decides it."""
    rows = _gathered(texts, fixes, approved, text_col, ids)
    at = F.greatest(F.lit(1), F.col("line"))
    verdict = (
        F.when(~F.coalesce(F.col("fix_type").isin("REPLACE", "DELETE", "INSERT"), F.lit(False)), "refused")
        .when(F.col("line").isNull() | ((F.col("fix_type") == "REPLACE") & (F.coalesce("find", F.lit("")) == ""))
              | ((F.col("fix_type") == "INSERT") & (F.coalesce("insert_content", F.lit("")) == "")), "incomplete")
        .when(F.coalesce("requires_confirmation", F.lit(False)) & ~F.col("_approved"), "not_approved")
        .when(F.col("_lines").isNull(), "no_text")
        .when(at > F.col("_lines"), "out_of_range")
    )
    judged = rows.select("*", at.alias("at"), verdict.alias("status"))
    edit = F.struct("seq", "fix_id", "fix_type", "line", "find", "find_kind", "replace", "insert_at", "insert_content")
    # First the fixes of a line, then the lines of a text: what is gathered is bounded by the text's own lines.
    by_line = judged.where("status IS NULL").groupBy(*ids, "at").agg(F.array_sort(F.collect_list(edit)).alias("fixes"))
    by_text = by_line.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("at", "fixes"))).alias("_edits"))
    here = _all([same(F.col(f"f.{c}"), F.col(f"o.{c}")) for c in ids])
    return texts.alias("f").join(by_text.alias("o"), here, "left").select("f.*", "o._edits"), judged


def apply_fixes(texts: DataFrame, fixes: DataFrame, text_col: str = "code", id_cols: Sequence[str] = ("file",),
                approved: DataFrame | None = None) -> Applied:
    """Apply a table of fixes to a table of texts (F4-F7). See the module's text for columns, order and statuses.

    `approved` (ids..., fix_id) holds the confirmed fixes (F8): a fix that requires confirmation is applied if it is
    among them. Without `approved` none of these is applied.
    """
    ids = list(id_cols)
    # Ids without a null meet by `=`, which keeps a partitioning by ids that the texts have already; `<=>` would shuffle all anew.
    whole = _all([F.col(c).isNotNull() for c in ids])
    parts = [
        _met(texts.where(some), fixes.where(some), None if approved is None else approved.where(some), text_col, ids, same)
        for some, same in ((whole, Column.__eq__), (~whole, Column.eqNullSafe))
    ]
    met, judged = (one.union(other) for one, other in zip(*parts))
    lines = split_lines(F.coalesce(text_col, F.lit("")))
    edits = F.transform(
        F.filter("_edits", lambda e: e["at"] <= F.size("_split")),
        lambda e: F.struct(e["at"].alias("at"), e["fixes"].alias("fixes"), _line_edit(F.element_at("_split", e["at"]), e["fixes"]).alias("new")))
    # `explode` gives one row a text; over a plain column the optimizer would write the edits into each side of the union
    split = met.withColumn("_split", F.explode(F.array(F.when(F.col("_edits").isNotNull(), lines))))
    done = split.withColumn("_done", edits)
    changed = F.aggregate("_done", F.lit(0), lambda n, e: n + F.size(F.filter(e["new"]["status"], lambda s: s == "applied")))
    fixed = done.select(
        *(F.col(f"`{c}`") for c in texts.columns),
        F.when(F.size("_done") > 0, _rebuilt(F.col("_split"), F.col("_done"))).otherwise(F.col(text_col)).alias("code_fixed"),
        F.coalesce(changed, F.lit(0)).alias("n_applied"),
    )
    # `explode` alone would have the optimizer test the size of `_done` below, and make every edit twice
    each = done.select(*ids, F.explode_outer("_done").alias("e")).where("e IS NOT NULL").select(
        *ids, F.explode(F.arrays_zip(F.col("e.fixes").alias("fix"), F.col("e.new.status").alias("status"))).alias("z"))
    statuses = each.select(*ids, "z.fix.fix_id", "z.fix.line", "z.fix.fix_type", "z.status").unionByName(
        judged.where("status IS NOT NULL").select(*ids, "fix_id", "line", "fix_type", "status"))
    return Applied(fixed, statuses.withColumn("applied", F.col("status") == "applied"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out

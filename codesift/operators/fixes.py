"""Fix planning and application.

The plan is derived from each row's own hits and applied to that row's lines
inside the row (higher-order functions over the line array), so producing a
fixed corpus needs no join and no shuffle of the text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import to_java
from ..functions.lines import decode_line, decode_rule
from ..rules import Rule, rules_for
from .scan import HITS, TEXT, rule_attr, spread, with_hits

# ---------------------------------------------------------------------------
# Fix templates. Patterns in JS dialect; `$1` refers to a group.
# ---------------------------------------------------------------------------
SECRET_IDS = ["API_KEY", "AWS_ACCESS_KEY", "PASSWORD", "DB_URL", "PRIVATE_KEY", "GITHUB_TOKEN", "GENERIC_SECRET"]
TEMPLATE_IDS = ["CONSOLE_LOG", "TODO_FIXME", "EMPTY_CATCH", "SENSITIVE_DATA_LOG", "DEBUG_ENABLED"]
SECRET_FIND = (r"""=\s*(['"])([^'"]{4,})\1""", "")
SECRET_REPLACE = "= process.env.{env}"
TODO_FIND = (r"""\/\/\s*(?:TODO|FIXME):?\s*""", "i")
TODO_REPLACE = "// TRACKED: "
EMPTY_CATCH_FIND = (r"""catch\s*\(\s*(\w+)\s*\)\s*\{\s*\}""", "")
EMPTY_CATCH_REPLACE = "catch ($1) { console.error($1); }"
DEBUG_FIND = (r"""debug\s*:\s*true""", "i")
DEBUG_REPLACE = "debug: process.env.NODE_ENV !== 'production'"


def _first_only(find: tuple[str, str], replace: str) -> tuple[str, str]:
    """Java pattern/replacement that replace only the first match.

    `regexp_replace` replaces every match, so the pattern is anchored as
    `\\A(.*?)find` and the lazy prefix is put back; group numbers shift by one.
    """
    pat = to_java(*find)
    flags = ""
    if pat.startswith("(?i)"):
        flags, pat = "(?i)", pat[4:]
    pat = re.sub(r"\\(\d)", lambda m: "\\" + str(int(m.group(1)) + 1), pat)
    rep = re.sub(r"\$(\d)", lambda m: "$" + str(int(m.group(1)) + 1), replace.replace("\\", "\\\\"))
    return f"(?s){flags}\\A(.*?){pat}", "$1" + rep


def env_name(rule_id: Column) -> Column:
    """non-word characters to `_`, upper case."""
    return F.upper(F.regexp_replace(rule_id, r"[^A-Za-z0-9_]", "_"))


def fix_template(rule_id: Column, kind: Column, line: Column) -> Column:
    """F1 + F3: a fix struct for a finding, or null when the rule has none."""
    sec_find, _ = _first_only(SECRET_FIND, "")
    env = env_name(rule_id)

    def mk(fix_type, find, replace, confirm, description):
        return F.struct(
            F.concat(F.lit("fix-"), rule_id, F.lit("-"), line.cast("string")).alias("fix_id"),
            rule_id.alias("rule_id"),
            F.lit(fix_type).alias("fix_type"),
            line.cast("int").alias("line"),
            (find if isinstance(find, Column) else F.lit(find)).cast("string").alias("find"),
            (replace if isinstance(replace, Column) else F.lit(replace)).cast("string").alias("replace"),
            F.lit(None).cast("string").alias("insert_at"),
            F.lit(None).cast("string").alias("insert_content"),
            F.lit(confirm).alias("requires_confirmation"),
            (description if isinstance(description, Column) else F.lit(description)).alias("description"),
        )

    todo = _first_only(TODO_FIND, TODO_REPLACE)
    catch = _first_only(EMPTY_CATCH_FIND, EMPTY_CATCH_REPLACE)
    debug = _first_only(DEBUG_FIND, DEBUG_REPLACE)
    secret_rep = F.concat(F.lit("$1= process.env."), env)
    return (F.when((kind == "secret") | rule_id.isin(SECRET_IDS),
                   mk("REPLACE", sec_find, secret_rep, True,
                      F.concat(F.lit("move the secret to process.env."), env)))
            .when(rule_id == "CONSOLE_LOG", mk("DELETE", None, None, False, "remove the console call"))
            .when(rule_id == "TODO_FIXME", mk("REPLACE", todo[0], todo[1], False, "mark the TODO as tracked"))
            .when(rule_id == "EMPTY_CATCH", mk("REPLACE", catch[0], catch[1], False, "log the caught error"))
            .when(rule_id == "SENSITIVE_DATA_LOG", mk("DELETE", None, None, True, "remove the leaking log call"))
            .when(rule_id == "DEBUG_ENABLED", mk("REPLACE", debug[0], debug[1], False, "derive debug from NODE_ENV")))


def fixable(rules: Sequence[Rule]) -> list[Rule]:
    """The rules that `fix_template` has a fix for; the findings of the others change neither a plan nor a text."""
    found = [r for r in rules if r.kind == "secret" or r.rule_id in SECRET_IDS or r.rule_id in TEMPLATE_IDS]
    return found or list(rules)  # a scan needs a rule


def _replaced(text: Column, fix) -> Column:
    return F.regexp_replace(text, fix["find"], fix["replace"])


def _applied(lines: Column, fix) -> Column:
    """F4/F5/F7 status against the original line: in range, and (REPLACE) text changed."""
    n = F.size(lines)
    idx = F.greatest(F.lit(1), fix["line"])
    orig = F.element_at(lines, F.least(idx, F.greatest(n, F.lit(1))))
    in_range = idx <= n
    return (F.when(fix["fix_type"] == "REPLACE", in_range & (_replaced(orig, fix) != orig))
            .when(fix["fix_type"] == "DELETE", in_range)
            .when(fix["fix_type"] == "INSERT",
                  in_range & fix["insert_content"].isNotNull() & (F.length(fix["insert_content"]) > 0))
            .otherwise(F.lit(False)))


def _planned(df: DataFrame, text_col: str, id_cols: Sequence[str], rules: Sequence[Rule], keep: Sequence[str] = ()):
    # Matching runs on the safe text; lines and corrected texts come from the text as it is.
    hits = with_hits(spread(df, id_cols, text_col), text_col, id_cols, rules, keep=[text_col, *keep])
    lines = F.when(F.size(HITS) > 0, F.split(F.col(text_col), "\n", -1))

    def plan(h):
        r = decode_rule(h)
        return fix_template(rule_attr(rules, r, "rule_id"), rule_attr(rules, r, "kind"), decode_line(h))

    planned = hits.select(*id_cols, *keep, F.col(text_col).alias(TEXT), HITS, lines.alias("_lines"),
                          F.filter(F.transform(HITS, plan), lambda f: f.isNotNull()).alias("_fixes"))
    return planned


def plan_fixes(df: DataFrame, text_col: str = "code", id_cols: Sequence[str] = ("file",),
               rules: Sequence[Rule] | None = None) -> DataFrame:
    """F1-F3 (+ status): one row per fix, with `applied` = the edit would change the text."""
    id_cols = list(id_cols)
    rules = fixable(rules_for(rules=rules))
    p = _planned(df, text_col, id_cols, rules)
    with_status = p.select(*id_cols, F.transform("_fixes", lambda f: F.struct(
        f.alias("f"), _applied(F.col("_lines"), f).alias("applied"))).alias("_st"))
    flat = with_status.select(*id_cols, F.explode_outer("_st").alias("s")).filter(F.col("s").isNotNull())
    return flat.select(*id_cols, "s.f.*", F.col("s.applied").alias("applied"))


def apply_to_lines(lines: Column, fixes: Column) -> Column:
    """F4-F7 on one text: fixes refer to the original line numbers.

    Several fixes on a line run in plan (rule) order; a DELETE removes the
    line and its break; INSERT puts content above (ABOVE) or below the line.
    Only lines that carry fixes are rewritten.
    """
    fl = F.array_distinct(F.transform(fixes, lambda f: F.greatest(F.lit(1), f["line"])))

    def rewrite(ln):
        here = F.filter(fixes, lambda f: F.greatest(F.lit(1), f["line"]) == ln)
        orig = F.element_at(lines, ln)
        deleted = F.exists(here, lambda f: f["fix_type"] == "DELETE")
        replaced = F.aggregate(F.filter(here, lambda f: f["fix_type"] == "REPLACE"), orig,
                               lambda acc, f: _replaced(acc, f))
        above = F.transform(F.filter(here, lambda f: (f["fix_type"] == "INSERT") & (f["insert_at"] == "ABOVE")),
                            lambda f: f["insert_content"])
        below = F.transform(F.filter(here, lambda f: (f["fix_type"] == "INSERT")
                                     & (F.coalesce(f["insert_at"], F.lit("")) != "ABOVE")),
                            lambda f: f["insert_content"])
        body = F.when(deleted, F.array().cast("array<string>")).otherwise(F.array(replaced))
        return F.struct(ln.alias("k"), F.concat(above, body, below).alias("v"))

    n = F.size(lines)
    in_range = F.filter(fl, lambda ln: ln <= n)
    m = F.map_from_entries(F.transform(in_range, rewrite))
    new = F.transform(lines, lambda x, i: F.coalesce(m[i + 1], F.array(x)))
    return F.array_join(F.flatten(new), "\n")


def _with_approved(df: DataFrame, approved: DataFrame, text_col: str, id_cols: list[str], rules: Sequence[Rule]) -> DataFrame:
    """`df` with `_approved`, the confirmed fix ids of each text.

    Only ids that a fix of the text can have count (a known rule, one of the text's lines), so the list of a text is
    bounded by its own lines, whatever else was approved.
    """
    named = approved.select(*id_cols, "fix_id", F.regexp_extract("fix_id", r"^fix-(.+)-(\d{1,9})$", 1).alias("_rule"),
                            F.regexp_extract("fix_id", r"^fix-(.+)-(\d{1,9})$", 2).try_cast("int").alias("_line"))
    named = named.filter(F.col("_rule").isin([r.rule_id for r in rules]) & F.col("_line").isNotNull()).distinct()
    counts = df.select(*id_cols, F.size(F.split(text_col, "\n", -1)).alias("_n")).groupBy(*id_cols).agg(F.max("_n").alias("_n"))
    same = None
    for c in id_cols:
        one = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        same = one if same is None else same & one
    possible = named.alias("a").join(counts.alias("b"), same & (F.col("a._line") <= F.col("b._n")), "left_semi")
    lists = possible.groupBy(*id_cols).agg(F.collect_set("fix_id").alias("_approved"))
    return df.alias("a").join(lists.alias("b"), same, "left").select("a.*", "b._approved")


def fixed_texts(df: DataFrame, text_col: str = "code", id_cols: Sequence[str] = ("file",),
                rules: Sequence[Rule] | None = None, approve_all: bool = False,
                approved: DataFrame | None = None) -> DataFrame:
    """The corrected corpus: (ids, code_fixed, n_fixes, n_applied). Row-local; a shuffle only to meet `approved`.

    F8: fixes that need confirmation are applied only with `approve_all`, or
    if their (ids, fix_id) is in `approved`.
    """
    id_cols = list(id_cols)
    rules = fixable(rules_for(rules=rules))
    confirmed = ["_approved"] if approved is not None and not approve_all else []
    if confirmed:
        df = _with_approved(df, approved, text_col, id_cols, rules)
    p = _planned(df, text_col, id_cols, rules, keep=confirmed)
    if approve_all:
        usable = F.col("_fixes")
    elif confirmed:
        usable = F.filter("_fixes", lambda f: ~f["requires_confirmation"] | F.coalesce(F.array_contains("_approved", f["fix_id"]), F.lit(False)))
    else:
        usable = F.filter("_fixes", lambda f: ~f["requires_confirmation"])
    usable = F.filter(usable, lambda f: f["fix_type"] != "MULTI_FILE")
    out = p.select(*id_cols, TEXT, "_lines", usable.alias("_use"))
    return out.select(
        *id_cols,
        F.when(F.size("_use") > 0, apply_to_lines(F.col("_lines"), F.col("_use"))).otherwise(F.col(TEXT))
        .alias("code_fixed"),
        F.size("_use").cast("int").alias("n_fixes"),
        F.size(F.filter("_use", lambda f: _applied(F.col("_lines"), f))).cast("int").alias("n_applied"),
    )


def before_after(before: DataFrame, after: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """per (ids, rule): findings before and after, and fixed/remaining/new."""
    keys = [*id_cols, "rule_id"]
    b = before.groupBy(*keys).agg(F.count(F.lit(1)).alias("before"))
    a = after.groupBy(*keys).agg(F.count(F.lit(1)).alias("after"))
    j = b.join(a, keys, "full_outer")
    bc, ac = F.coalesce("before", F.lit(0)), F.coalesce("after", F.lit(0))
    return j.select(*keys, bc.cast("bigint").alias("before"), ac.cast("bigint").alias("after"),
                    F.when(ac == 0, "fixed").when(bc == 0, "new")
                    .when(ac < bc, "reduced").when(ac == bc, "remaining").otherwise("increased").alias("status"))


def fix_and_rescan(df: DataFrame, text_col: str = "code", id_cols: Sequence[str] = ("file",),
                   rules: Sequence[Rule] | None = None, approve_all: bool = False) -> DataFrame:
    """F9 without a shuffle: scan, fix, scan the fixed text and compare, all inside the row.

    Same output as `before_after(scan(df), scan(fixed), ids)`: per (ids, rule)
    the findings before and after, and fixed/new/reduced/remaining/increased.
    """
    id_cols = list(id_cols)
    rules = rules_for(rules=rules)
    p = _planned(df, text_col, id_cols, rules)
    usable = (F.col("_fixes") if approve_all
              else F.filter("_fixes", lambda f: ~f["requires_confirmation"]))
    usable = F.filter(usable, lambda f: f["fix_type"] != "MULTI_FILE")
    fixed = p.select(*id_cols, F.col(HITS).alias("_before"),
                     F.when(F.size(usable) > 0, apply_to_lines(F.col("_lines"), usable))
                     .otherwise(F.col(TEXT)).alias("_fixed"))
    again = with_hits(fixed, "_fixed", id_cols, rules, keep=["_before"])
    rb = F.transform("_before", decode_rule)
    ra = F.transform(HITS, decode_rule)
    per_rule = F.transform(F.array_distinct(F.concat(rb, ra)), lambda r: F.struct(
        r.alias("r"),
        F.size(F.filter(rb, lambda x: x == r)).cast("bigint").alias("before"),
        F.size(F.filter(ra, lambda x: x == r)).cast("bigint").alias("after")))
    flat = (again.select(*id_cols, F.explode_outer(per_rule).alias("c")).filter(F.col("c").isNotNull()))
    bc, ac = F.col("c.before"), F.col("c.after")
    return flat.select(*id_cols, rule_attr(rules, F.col("c.r"), "rule_id").alias("rule_id"),
                       bc.alias("before"), ac.alias("after"),
                       F.when(ac == 0, "fixed").when(bc == 0, "new")
                       .when(ac < bc, "reduced").when(ac == bc, "remaining").otherwise("increased").alias("status"))

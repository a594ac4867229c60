"""Report files (S5-S9): a report's lines written in order, in parallel.

A report is a table of lines with an order: head, for each file (or domain) its heading and its findings, foot. The
lines are range-partitioned by that order and sorted, so the part files in the order of their names, one behind the
other, are the report; no task holds a report, a file's findings or a domain's. `merged` reads them back as one table.
The counts in headings come from aggregations, so a file with a third of all findings is only more lines.

Differences from one file written by hand: the last line ends with a line break, and the JSON report has one line a
finding (it is one array of `{file, issues}` as it stands, `[` and `]` on lines of their own).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, stored
from . import reports as rp
from .knowledge import with_explanation

FORMATS = ("text", "markdown", "json", "domain", "listing")

# Heads and foots.
RULE = "=" * 60
NOTHING, NONE_FOUND = "No issues found.", "No issues detected."
TOTAL = "Total: %d issue(s)"

#: Order of a line: part of the report (head, body, foot), group, place in the group (heading, finding, end), finding.
_KEY = ["_part", "_group", "_place", "_item"]
_HEADING, _FINDING, _END = 0, 1, 2


def _lines(df: DataFrame, text: Column, part: int, group: Column | None = None, place: int = 0, item: Column | None = None,
           group_type: str = "string", item_type: str = "string") -> DataFrame:
    g = F.lit(None).cast(group_type) if group is None else group
    i = F.lit(None).cast(item_type) if item is None else item
    return df.select(F.lit(part).alias("_part"), g.alias("_group"), F.lit(place).alias("_place"), i.alias("_item"), text.alias("text"))


def report_lines(findings: DataFrame, fmt: str = "text", file_cols: Sequence[str] = ("file",)) -> DataFrame:
    """The lines of a report with their order: (_part, _group, _place, _item, text). A text may hold several lines."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    files = list(file_cols)
    held = materialize(findings)  # counts and lines both read it; the scan under it runs once
    name = F.concat_ws("/", *(F.col(c).cast("string") for c in files))
    severity = F.upper(F.col("severity"))
    item = F.struct("rule_seq", "line", "rule_id", "message", "severity")
    group = F.struct(*files)
    types = {"item_type": held.select(item.alias("i")).schema["i"].dataType.simpleString(),
             "group_type": held.select(group.alias("g")).schema["g"].dataType.simpleString()}
    all_of = rp.totals(held, files)
    n, n_files, some = F.col("n_findings"), F.col("n_files"), F.col("n_findings") > 0
    per_file = held.groupBy(*files).agg(F.count(F.lit(1)).alias("n"))
    if fmt == "text":
        entry = F.format_string(rp.TEXT_ITEM, severity, F.col("line"), F.col("rule_id"), F.col("message"))
        parts = [_lines(per_file, F.format_string(rp.TEXT_HEADER, name, F.col("n")), 1, group, _HEADING, **types),
                 _lines(held, entry, 1, group, _FINDING, item, **types),
                 _lines(all_of, F.when(some, F.format_string(rp.TEXT_TOTAL, n, n_files)).otherwise(F.lit(NOTHING)), 2, **types)]
    elif fmt == "markdown":
        entry = F.format_string(rp.MD_ITEM, severity, F.col("line"), F.col("rule_id"), F.col("message"))
        parts = [_lines(rp.markdown_header(held, files), F.col("header"), 0, **types),
                 _lines(per_file, F.concat(F.lit("## `"), name, F.lit("`")), 1, group, _HEADING, **types),
                 _lines(held, entry, 1, group, _FINDING, item, **types),
                 _lines(per_file, F.lit(""), 1, group, _END, **types)]
    elif fmt == "json":
        parts = _json_lines(held, files, group, item, all_of, types)
    elif fmt == "listing":
        total = F.when(some, F.concat(F.lit("\n"), F.format_string(TOTAL + ".", n))).otherwise(F.lit(NONE_FOUND))
        parts = [_lines(rp.listing(held), F.col("entry"), 1, group, _FINDING, item, **types), _lines(all_of, total, 2, **types)]
    else:
        parts = _domain_lines(held, files, severity, all_of)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _json_lines(held, files, group, item, all_of, types) -> list[DataFrame]:
    """An array of files; the first file and a file's first issue have no comma before them."""
    issue = F.struct(F.col("rule_id").alias("id"), "domain", "severity", F.col("rule_id").alias("title"), "message", "line", "explanation")
    told = with_explanation(held).select("*", item.alias("_i"), F.to_json(issue, {"ignoreNullFields": "false"}).alias("_json"))
    firsts = held.groupBy(*files).agg(F.min(item).alias("_first"), F.count(F.lit(1)).alias("_n"))
    # which file comes first is one value; which issue does is one a file
    least = held.agg(F.min(group).alias("_least"))
    heads = firsts.join(F.broadcast(least), group.eqNullSafe(F.col("_least")), "left")
    named = F.to_json(F.struct(*(F.col(c) for c in files)), {"ignoreNullFields": "false"})
    opened = F.concat(F.when(F.col("_least").isNull(), F.lit(",")).otherwise(F.lit("")),
                      F.substring(named, F.lit(1), F.char_length(named) - 1), F.lit(',"issues":['))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in files]
    met = told.alias("a").join(firsts.alias("b"), same).select("a.*", "b._first")
    comma = F.when(F.col("_i") == F.col("_first"), F.lit("  ")).otherwise(F.lit(" ,"))
    return [_lines(all_of, F.lit("["), 0, **types), _lines(heads, opened, 1, group, _HEADING, **types),
            _lines(met, F.concat(comma, F.col("_json")), 1, group, _FINDING, F.col("_i"), **types),
            _lines(firsts, F.lit("]}"), 1, group, _END, **types), _lines(all_of, F.lit("]"), 2, **types)]


def _domain_lines(held, files, severity, all_of) -> list[DataFrame]:
    """S8 over everything: domains in the order in which they are first seen, with each finding's explanation."""
    domains = held.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.min("rule_seq").alias("_seq"))  # a row a domain
    told = with_explanation(held).join(F.broadcast(domains.select("domain", "_seq")), "domain")
    ex = F.col("explanation")
    more = F.when(ex.isNotNull(), F.concat_ws(
        "\n", F.concat(F.lit("  What: "), ex["what"]), F.concat(F.lit("  Why:  "), ex["why"]),
        F.when(F.size(ex["steps"]) > 0, F.concat(F.lit("  Fix:  "), F.get(ex["steps"], 0)["title"])),
        F.concat(F.lit("  Ref:  "), ex["standard"]["url"])))
    entry = F.concat_ws("\n", F.format_string("[%s] L%d: %s", severity, F.col("line"), F.col("rule_id")),
                        F.concat(F.lit("  "), F.col("message")), more, F.lit(""))
    group = F.struct(F.col("_seq"), F.col("domain"))
    item = F.struct(*files, "rule_seq", "line", "rule_id", "message")
    types = {"group_type": told.select(group.alias("g")).schema["g"].dataType.simpleString(),
             "item_type": told.select(item.alias("i")).schema["i"].dataType.simpleString()}
    head = F.format_string(f"{RULE}\nFindings report\n{TOTAL}\n{RULE}\n", F.col("n_findings"))
    return [_lines(all_of, head, 0, **types),
            _lines(domains, F.format_string("--- %s (%d) ---", F.col("domain"), F.col("n")), 1, group, _HEADING, **types),
            _lines(told, entry, 1, group, _FINDING, item, **types)]


def order_report_lines(rows: DataFrame, scope: Sequence[str]) -> DataFrame:
    """The lines of the order reports of all scopes (G6), from `relations.order_report_rows`."""
    s = list(scope)
    group = F.struct(*s) if s else F.lit(0)
    types = {"group_type": rows.select(group.alias("g")).schema["g"].dataType.simpleString(), "item_type": "int"}
    per = rows.groupBy(*s).agg(F.count(F.lit(1)).alias("n"))
    if not s:
        per = per.where("n > 0")
    head, foot = F.lit("## Fix order\n\n### Sequence\n"), F.format_string("\n_%d issue(s) analysed._", F.col("n"))
    return (_lines(per, head, 1, group, _HEADING, **types)
            .unionByName(_lines(rows, F.col("item"), 1, group, _FINDING, F.col("rank").cast("int"), **types))
            .unionByName(_lines(per, foot, 1, group, _END, **types)))


def write_lines(lines: DataFrame, path: str) -> None:
    """Write a report's lines to a folder of part files, in order."""
    lines.repartitionByRange(*_KEY, "text").sortWithinPartitions(*_KEY, "text").select("text").write.text(path)


def write_report(findings: DataFrame, path: str, fmt: str = "text", file_cols: Sequence[str] = ("file",)) -> None:
    write_lines(report_lines(findings, fmt, file_cols), path)


def merged(spark: SparkSession, path: str) -> DataFrame:
    """(n, text): the lines of a written report, numbered from 1.

    The files' order is the report's, so no line is moved: a line's number is its place in its split of a file plus the
    lines of the splits before. The table of splits has one row for each and is broadcast.
    """
    read = spark.read.text(path).select(
        F.col("_metadata.file_name").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_i"), F.col("value").alias("text"))
    held = stored(read, "zstd")  # keeps a line's place
    splits = held.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    earlier = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("_f", "_b", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    number = F.col("_i") - F.col("_first") + F.col("_before") + 1
    return held.join(F.broadcast(starts), ["_f", "_b"]).select(number.alias("n"), "text")


def written(spark: SparkSession, findings: DataFrame, fmt: str) -> DataFrame:
    """Write a report to the shared folder and read it back."""
    import uuid

    from ..session import checkpoint_dir

    path = f"{checkpoint_dir(spark).rstrip('/')}/report-{uuid.uuid4().hex}"
    write_report(findings, path, fmt)
    return merged(spark, path)

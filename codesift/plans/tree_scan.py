"""Scan a source tree end to end, as the reference's command line does (§3.1):
list files -> scan (minimum severity) -> report (text / markdown / json) -> gate.

`scan_tree` returns DataFrames; `write_tree_report` also writes the report as
part files in order. Turning the gate into an exit code is left to the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import reports as rp
from ..operators import sinks
from ..operators.scan import scan
from ..session import materialize
from ..sources.files import read_source_tree

FORMATS = ("text", "markdown", "json")


def scan_tree(spark: SparkSession, root: str, fmt: str = "text", min_severity: str = "low"):
    """(findings, report rows, footer/header rows, gate) for the files under `root`."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    files = read_source_tree(spark, root)
    findings: DataFrame = scan(files, "code", ["file"], min_severity=min_severity)
    if fmt == "text":
        body, extra = rp.text_report(findings), rp.text_totals(findings)
    elif fmt == "markdown":
        body, extra = rp.markdown_report(findings), rp.markdown_header(findings)
    else:
        body, extra = rp.json_report(findings), None
    return findings, body, extra, rp.gate(findings)


def write_tree_report(spark: SparkSession, root: str, path: str, fmt: str = "text", min_severity: str = "low") -> int:
    """Scan the files under `root`, write the report to `path`, and return the gate's exit code."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    findings = materialize(scan(read_source_tree(spark, root), "code", ["file"], min_severity=min_severity))
    sinks.write_report(findings, path, fmt)
    return rp.gate(findings).first()["exit_code"]

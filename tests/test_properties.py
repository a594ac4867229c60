"""Bulk property checks (seeded, one Spark job each):
* line numbers are within 1..n and (file, rule, line) is unique;
* for single-line rules, scanning snippets joined by blank lines equals the
  per-snippet scans shifted by their line offsets."""

import random

from codesift.operators.scan import scan
from codesift.rules import RULES_BY_ID
from codesift.sources.corpus import SNIPPETS

LOCAL_RULES = ["EVAL_USAGE", "CONSOLE_LOG", "PROCESS_EXIT", "JWT_INSECURE", "INSECURE_RANDOM", "OPEN_REDIRECT",
               "NO_INPUT_VALIDATION", "SYNC_FILE_IN_SERVER", "UNBOUNDED_CACHE", "WEAK_CRYPTO", "COOKIE_INSECURE",
               "POOR_NAMING", "SSRF"]
ONE_LINE = [c for _, _, c in SNIPPETS if "\n" not in c and c.rstrip().endswith(";")]


def test_concatenation_equals_shifted_scans(spark):
    rng = random.Random(7)
    files, parts = [], []
    for f in range(300):
        chosen = [rng.randrange(len(ONE_LINE)) for _ in range(rng.randint(1, 12))]
        files.append((f, "\n\n".join(ONE_LINE[i] for i in chosen)))
        parts.append(chosen)
    rules = [RULES_BY_ID[r] for r in LOCAL_RULES]
    got = {(r.file, r.rule_id, r.line) for r in scan(spark.createDataFrame(files, "file long, code string"),
                                                      rules=rules).collect()}
    single = spark.createDataFrame(list(enumerate(ONE_LINE)), "file long, code string")
    per = {}
    for r in scan(single, rules=rules).collect():
        per.setdefault(r.file, []).append((r.rule_id, r.line))
    want = set()
    for f, chosen in enumerate(parts):
        for k, i in enumerate(chosen):
            for rid, ln in per.get(i, []):
                want.add((f, rid, ln + 2 * k))
    assert got == want


def test_lines_in_range_and_unique(spark):
    rng = random.Random(11)
    codes = [(f, "\n".join(SNIPPETS[rng.randrange(len(SNIPPETS))][2] for _ in range(rng.randint(1, 15))))
             for f in range(300)]
    n_lines = {f: c.count("\n") + 1 for f, c in codes}
    rows = scan(spark.createDataFrame(codes, "file long, code string")).collect()
    keys = [(r.file, r.rule_id, r.line) for r in rows]
    assert len(keys) == len(set(keys))
    assert all(1 <= r.line <= n_lines[r.file] for r in rows)

"""Rule tables.

A rule is one regular expression with an id, a domain, a kind (the issue
type shown to users) and a raw severity. Patterns are written in the
JavaScript dialect the detection semantics are defined in; `functions.dialect`
turns them into exact Java (Spark) and RE2 (DuckDB oracle) equivalents.

Messages are our own short texts. Ids, domains, severities and patterns are
the interface and must not change.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rule:
    rule_id: str
    domain: str
    kind: str
    severity: str
    pattern: str  # JavaScript-dialect source
    flags: str = ""  # "i", "m" as in the JS literal
    message: str = ""
    # Linear-time equivalent of `pattern` (same matches, same match ends),
    # used when the original backtracks badly in Java. JS dialect plus
    # possessive quantifiers, which the Java side understands.
    safe_pattern: str | None = None
    # What to step over when the pattern fails at an opener: the run up to the
    # bracket that the opener and all further openers in the run share, so none
    # of them can match either. Keeps texts full of unclosed openers linear.
    skip_pattern: str | None = None
    # Literal substrings of which at least one must occur for any match;
    # lets the scan skip the regex on most texts. Compared on lower-cased
    # text when the rule is case-insensitive.
    needles: tuple[str, ...] = field(default_factory=tuple)


SEVERITY_RANK = {"low": 0, "medium": 1, "high": 2, "critical": 3}
SEVERITY_ORDER = ["critical", "high", "medium", "low"]
DOMAIN_ORDER = ["Security", "Quality", "DevOps", "Scalability"]


def _r(rule_id, domain, kind, severity, pattern, flags="", message="", safe=None, needles=(), skip=None):
    return Rule(rule_id, domain, kind, severity, pattern, flags, message, safe, skip, tuple(needles))


# ---------------------------------------------------------------------------
# Rule ids, raw severities and detection patterns (JS dialect),
# in the reference's order (Security 17, Quality 8, DevOps 6, Scalability 6).
# ---------------------------------------------------------------------------
SECURITY_RULES = [
    _r("SQL_INJECTION", "Security", "vulnerability", "critical",
       r"""['"`][^'"`\r\n]*\b(?:SELECT|INSERT|UPDATE|DELETE|DROP|WHERE|FROM|UNION)\b[^'"`\r\n]*['"`]\s*\+""", "i",
       "SQL text is concatenated with a value; bind parameters instead",
       safe=r"""['"`](?=[^'"`\r\n]*+['"`]\s*+\+)[^'"`\r\n]*\b(?:SELECT|INSERT|UPDATE|DELETE|DROP|WHERE|FROM|UNION)\b[^'"`\r\n]*+['"`]\s*+\+""",
       needles=(("+",), ("select", "insert", "update", "delete", "drop", "where", "from", "union"))),
    _r("EVAL_USAGE", "Security", "vulnerability", "critical",
       r"""\beval\s*\(""", "",
       "eval() runs arbitrary code", needles=("eval",)),
    _r("XSS_INNER_HTML", "Security", "vulnerability", "high",
       r"""\.innerHTML\s*\+?=(?!=)""", "",
       "innerHTML is assigned; user data here becomes markup", needles=(".innerHTML",)),
    _r("WEAK_CRYPTO", "Security", "vulnerability", "medium",
       r"""createHash\s*\(\s*['"](?:md5|sha1|sha-1)['"]\s*\)|\bmd5\s*\(""", "i",
       "MD5/SHA-1 are broken hashes; use SHA-256 or stronger", needles=(("createhash", "md5"), ("md5", "sha1", "sha-1"))),
    _r("COMMAND_INJECTION", "Security", "vulnerability", "critical",
       r"""\b(?:exec|execSync|spawn|spawnSync)\s*\(\s*`[^`]*\$\{""", "",
       "shell command built from an interpolated template", needles=(("exec", "spawn"), ("`",), ("${",))),
    _r("INSECURE_RANDOM", "Security", "vulnerability", "medium",
       r"""\bMath\.random\s*\(\s*\)""", "",
       "Math.random() is predictable; use a crypto RNG for secrets", needles=("Math.random",)),
    _r("PATH_TRAVERSAL", "Security", "vulnerability", "high",
       r"""(?:readFile|writeFile|createReadStream|readFileSync)\s*\([^)]*(?:req\.|params\.|query\.|body\.)""", "i",
       "file path comes from request data", skip=r"""(?:readFile|writeFile|createReadStream|readFileSync)\s*+\([^)]*+""",
       needles=(("readfile", "writefile", "createreadstream"), ("req.", "params.", "query.", "body."))),
    _r("JWT_INSECURE", "Security", "vulnerability", "critical",
       r"""\bjwt\.decode\s*\(""", "",
       "jwt.decode() does not check the signature; use jwt.verify()", needles=("jwt.decode",)),
    _r("NOSQL_INJECTION", "Security", "vulnerability", "high",
       r"""(?:findOne|find|updateOne|deleteOne)\s*\(\s*\{[^}]*(?:req\.body|req\.params|req\.query)""", "i",
       "query object takes request fields unchecked", skip=r"""(?:findOne|find|updateOne|deleteOne)\s*+\(\s*+\{[^}]*+""",
       needles=(("req.",), ("find", "updateone", "deleteone"))),
    _r("DEBUG_ENABLED", "Security", "vulnerability", "medium",
       r"""(?:debug|DEBUG)\s*[:=]\s*true(?!\s*&&|\s*\|\|)""", "",
       "debug flag is hard-wired on", needles=("debug", "DEBUG")),
    _r("PROTOTYPE_POLLUTION", "Security", "vulnerability", "high",
       r"""Object\.assign\s*\([^,]+,\s*req\.""", "",
       "Object.assign() copies request data into an object", needles=("Object.assign",)),
    _r("SSRF", "Security", "vulnerability", "critical",
       r"""\bfetch\s*\(\s*req\.|axios\.(?:get|post|put|delete)\s*\(\s*req\.""", "",
       "outgoing request URL comes from the caller", needles=(("req.",), ("fetch", "axios."))),
    _r("CORS_ALL_ORIGINS", "Security", "vulnerability", "high",
       r"""cors\s*\(\s*\{[^}]*origin\s*:\s*['"`]\*['"`]""", "",
       "CORS allows every origin", skip=r"""cors\s*+\(\s*+\{[^}]*+""",
       needles=("cors",)),
    _r("COOKIE_INSECURE", "Security", "vulnerability", "high",
       r"""res\.cookie\s*\(\s*['"][^'"]+['"]\s*,\s*[^,)]+\s*\)(?!\s*;?\s*\/\/)""", "",
       "cookie set without options such as httpOnly", safe=r"""res\.cookie\s*+\(\s*+['"][^'"]++['"]\s*+,[^,)]++\)(?!\s*+(?:;\s*+)?\/\/)""",
       needles=("res.cookie",)),
    _r("OPEN_REDIRECT", "Security", "vulnerability", "medium",
       r"""res\.redirect\s*\(\s*req\.""", "",
       "redirect target comes from the request", needles=("res.redirect",)),
    _r("SENSITIVE_DATA_LOG", "Security", "vulnerability", "high",
       r"""console\.\w+\s*\([^)]*(?:password|passwd|secret|token|apiKey|api_key)[^)]*\)""", "i",
       "a credential is written to the log", skip=r"""console\.\w++\s*+\([^)]*+""",
       needles=(("console.",), ("password", "passwd", "secret", "token", "apikey", "api_key"))),
    _r("DANGEROUS_HTML", "Security", "vulnerability", "high",
       r"""dangerouslySetInnerHTML\s*=\s*\{\s*\{\s*__html\s*:\s*(?!.*DOMPurify)""", "",
       "dangerouslySetInnerHTML without sanitising", needles=("dangerouslySetInnerHTML",)),
]

QUALITY_RULES = [
    _r("EMPTY_CATCH", "Quality", "quality", "high",
       r"""catch\s*\([^)]*\)\s*\{\s*(?:\/\/[^\n]*)?\s*\}""", "",
       "catch block swallows the error", safe=r"""catch\s*+\([^)]*+\)\s*+\{\s*+(?:\/\/(?:[^\n]*[^\s])?\s*+)?\}""",
       skip=r"""catch\s*+\([^)]*+""",
       needles=("catch",)),
    _r("CONSOLE_LOG", "Quality", "quality", "low",
       r"""\bconsole\s*\.\s*(?:log|debug|info)\s*\(""", "",
       "console output left in code", needles=("console",)),
    _r("TODO_FIXME", "Quality", "quality", "low",
       r"""\/\/\s*(?:TODO|FIXME|HACK|XXX)\b""", "i",
       "open TODO/FIXME/HACK marker", needles=("//",)),
    _r("MAGIC_NUMBER", "Quality", "quality", "low",
       r"""(?<![.\w])(?<!\.)\b(?!(?:0|1|2|-1)\b)\d{2,}\b(?!\s*[,\]\)]?\s*(?:ms|px|vh|vw|em|rem|%|s\b))""", "",
       "unnamed numeric literal",
       safe=r"""(?=\d\d)(?<![.\w])(?<!\.)\b(?!(?:0|1|2|-1)\b)\d{2,}\b(?!\s*[,\]\)]?\s*(?:ms|px|vh|vw|em|rem|%|s\b))"""),
    _r("TOO_MANY_PARAMS", "Quality", "quality", "medium",
       r"""(?:function\s+\w+|(?:const|let|var)\s+\w+\s*=\s*(?:async\s*)?\()\s*[^)]*,\s*[^)]*,\s*[^)]*,\s*[^)]*,\s*[^)]*[^)]*\)""", "",
       "five or more parameters",
       safe=r"""(?=[fclv])(?:function\s+\w+|(?:const|let|var)\s+\w+\s*=\s*(?:async\s*)?\()(?:[^,)]*+,){4}[^)]*+\)""",
       needles=("function", "const", "let", "var")),
    _r("DEEP_NESTING", "Quality", "quality", "medium",
       r"""^(?:\t| {2}){4,}(?:if|for|while|switch)\s*\(""", "m",
       "control flow nested four levels or more",
       safe=r"""^(?:\t| {2}){4,}+(?:if|for|while|switch)\s*\(""",
       needles=(("\t", " " * 8), ("if", "for", "while", "switch"))),
    _r("POOR_NAMING", "Quality", "quality", "low",
       r"""\b(?:let|const|var)\s+([a-z])\s*[=:]""", "",
       "one-letter variable name", safe=r"""(?=[lcv])\b(?:let|const|var)\s+([a-z])\s*[=:]""",
       needles=(("let", "const", "var"),)),
    _r("LONG_FUNCTION", "Quality", "quality", "medium",
       r"""(?:function\s+\w+|=>\s*)\{(?:[^{}]|\{[^{}]*\}){500,}""", "",
       "function body is very long",
       safe=r"""(?:function\s+\w+|=>\s*)\{(?:[^{}]|\{[^{}]*+\}){500,}+""",
       needles=("function", "=>")),
]

DEVOPS_RULES = [
    _r("HARDCODED_IP", "DevOps", "devops", "medium",
       r"""['"`][^'"`\r\n]*(?:\d{1,3}\.){3}\d{1,3}[^'"`\r\n]*['"`]""", "",
       "IP address written into a string", needles=((".",), ("'", '"', "`"))),
    _r("UNHANDLED_PROMISE", "DevOps", "devops", "high",
       r"""^(?!.*\.catch\b).*\.then\s*\(""", "m",
       ".then() on a line with no .catch()", safe=r"""^(?=.*?\.then)(?!.*\.catch\b).*\.then\s*\(""",
       needles=(".then",)),
    _r("PROCESS_EXIT", "DevOps", "devops", "medium",
       r"""\bprocess\.exit\s*\(""", "",
       "process.exit() ends the service abruptly", needles=("process.exit",)),
    _r("SYNC_FILE_IN_SERVER", "DevOps", "devops", "high",
       r"""\bfs\.(?:readFileSync|writeFileSync|appendFileSync|existsSync|mkdirSync|readdirSync)\s*\(""", "",
       "blocking file call", needles=("fs.",)),
    _r("MISSING_TIMEOUT", "DevOps", "devops", "medium",
       r"""\bawait\s+fetch\s*\(\s*[^,)]+\s*\)(?!\s*\/\*[^*]*timeout)""", "",
       "fetch() without a timeout", safe=r"""\bawait\s++fetch\s*+\([^,)]++\)(?!\s*+\/\*[^*]*timeout)""",
       skip=r"""\bawait\s++fetch\s*+\([^,)]*+""",
       needles=(("fetch",), ("await",))),
    _r("NO_INPUT_VALIDATION", "DevOps", "devops", "high",
       r"""\breq\.(?:body|params|query)\b""", "",
       "request input used without a schema check", needles=("req.",)),
]

SCALABILITY_RULES = [
    _r("SEQUENTIAL_ASYNC", "Scalability", "scalability", "high",
       r"""\bfor\s*(?:Of|In)?\s*(?:await\s*)?\([^)]*\)\s*\{[^}]*\bawait\b|\bwhile\s*\([^)]*\)\s*\{[^}]*\bawait\b""", "",
       "await inside a loop serialises the calls", safe=r"""\bfor\s*+(?:Of|In)?\s*+(?:await\s*+)?\([^)]*+\)\s*+\{[^}]*\bawait\b|\bwhile\s*+\([^)]*+\)\s*+\{[^}]*\bawait\b""",
       skip=r"""\bfor\s*+(?:Of|In)?\s*+(?:await\s*+)?\([^)]*+|\bwhile\s*+\([^)]*+""",
       needles=(("await",), ("for", "while"))),
    _r("N_PLUS_ONE", "Scalability", "scalability", "high",
       r"""\bfor\s*(?:Of|In)?\s*(?:await\s*)?\([^)]*\)\s*\{[^}]*\b(?:db\.|query\s*\(|findOne|findAll|find\s*\()""", "",
       "one query per loop iteration", safe=r"""\bfor\s*+(?:Of|In)?\s*+(?:await\s*+)?\([^)]*+\)\s*+\{[^}]*\b(?:db\.|query\s*+\(|findOne|findAll|find\s*+\()""",
       skip=r"""\bfor\s*+(?:Of|In)?\s*+(?:await\s*+)?\([^)]*+""",
       needles=(("for",), ("db.", "query", "findOne", "findAll", "find"))),
    _r("NO_PAGINATION", "Scalability", "scalability", "medium",
       r"""['"`]SELECT\s+\*\s+FROM\s+\w+(?:\s+WHERE[^'"`]*)?['"`](?![^'"`,;]*\bLIMIT\b)""", "i",
       "SELECT * without LIMIT", needles=(("select",), ("from",))),
    _r("NESTED_LOOP", "Scalability", "scalability", "medium",
       r"""\.forEach\([^{]*\{[^}]*?\.forEach\(""", "",
       "forEach nested in forEach", safe=r"""\.forEach\([^{]*+\{[^}]*?\.forEach\(""", needles=(".forEach(",)),
    _r("STRING_CONCAT_LOOP", "Scalability", "scalability", "medium",
       r"""\bfor\b[^{]*\{[^}]*\+=\s*['"`][^'"`]*['"`]|\bfor\b[^{]*\{[^}]*\+=\s*\w+""", "",
       "string built with += in a loop", safe=r"""\bfor\b[^{]*+\{[^}]*\+=\s*+['"`][^'"`]*+['"`]|\bfor\b[^{]*+\{[^}]*\+=\s*+\w+""",
       skip=r"""\bfor\b[^{]*+""",
       needles=(("+=",), ("for",))),
    _r("UNBOUNDED_CACHE", "Scalability", "scalability", "medium",
       r"""\bnew\s+Map\s*\(\s*\)\s*;|new\s+Set\s*\(\s*\)\s*;""", "",
       "Map/Set cache without a size bound", needles=("new",)),
]

# ---------------------------------------------------------------------------
# Secret types. The names are fixed values; the detector patterns are our own
# design (no detector source exists to match). All secrets are critical.
# ---------------------------------------------------------------------------
SECRET_RULES = [
    _r("AWS_ACCESS_KEY", "Security", "secret", "critical",
       r"""\bAKIA[0-9A-Z]{16}\b""", "",
       "hardcoded secret", needles=("AKIA",)),
    _r("OPENAI_API_KEY", "Security", "secret", "critical",
       r"""\bsk-[A-Za-z0-9_-]{20,}""", "",
       "hardcoded secret", needles=("sk-",)),
    _r("GITHUB_TOKEN", "Security", "secret", "critical",
       r"""\bgh[posr]_[A-Za-z0-9]{36,}""", "",
       "hardcoded secret", needles=("gh",)),
    _r("PRIVATE_KEY", "Security", "secret", "critical",
       r"""-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----""", "",
       "hardcoded secret", needles=("PRIVATE KEY",)),
    _r("DB_URL", "Security", "secret", "critical",
       r"""\b[a-z][a-z0-9+.-]*:\/\/[^\s:\/@'"`]+:[^\s@'"`]+@[^\s'"`]+""", "i",
       "hardcoded secret", needles=(("://",), ("@",))),
    _r("PASSWORD", "Security", "secret", "critical",
       r"""\b(?:password|passwd|pwd|passphrase)\s*[:=]\s*['"`][^'"`\s]{4,}['"`]""", "i",
       "hardcoded secret", needles=("pass", "pwd")),
    _r("API_KEY", "Security", "secret", "critical",
       r"""\bapi[_-]?key\s*[:=]\s*['"`][^'"`\s]{8,}['"`]""", "i",
       "hardcoded secret", needles=("api",)),
    _r("GENERIC_SECRET", "Security", "secret", "critical",
       r"""\b(?:secret|token|client_secret|auth_token|access_token)\s*[:=]\s*['"`][^'"`\s]{8,}['"`]""", "i",
       "hardcoded secret", needles=("secret", "token")),
]

# Full-scan order: Security, secrets, Quality, DevOps, Scalability.
ALL_RULES = SECURITY_RULES + SECRET_RULES + QUALITY_RULES + DEVOPS_RULES + SCALABILITY_RULES
RULES_BY_ID = {r.rule_id: r for r in ALL_RULES}

RULE_SETS = {
    "security": SECURITY_RULES,
    "secrets": SECRET_RULES,
    "quality": QUALITY_RULES,
    "devops": DEVOPS_RULES,
    "scalability": SCALABILITY_RULES,
    "all": ALL_RULES,
}


def rules_for(domains=None, kinds=None, min_severity=None, rules=None):
    """Prune the rule list before scanning (static severity is known up front).

    An unknown minimum severity selects nothing, as a comparison against an
    unknown rank is false for every finding.
    """
    out = list(ALL_RULES if rules is None else rules)
    if domains is not None:
        out = [r for r in out if r.domain in set(domains)]
    if kinds is not None:
        out = [r for r in out if r.kind in set(kinds)]
    if min_severity is not None:
        if min_severity not in SEVERITY_RANK:
            return []
        k = SEVERITY_RANK[min_severity]
        out = [r for r in out if SEVERITY_RANK.get(r.severity, 0) >= k]
    return out

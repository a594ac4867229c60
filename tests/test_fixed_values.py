"""The tables that results depend on, stated here once more from the description of the rules, not read from the library.

The SQL oracles take rules, guides and edges from the library's tables, so a wrong entry there would pass them.
"""

from codesift import rules
from codesift.knowledge_data import EXPLANATIONS, GUIDES
from codesift.operators import severity
from codesift.operators.relations import EDGES, VERBS

# Rules in scan order, with their raw severity.
SECURITY = """SQL_INJECTION critical, EVAL_USAGE critical, XSS_INNER_HTML high, WEAK_CRYPTO medium, COMMAND_INJECTION critical,
INSECURE_RANDOM medium, PATH_TRAVERSAL high, JWT_INSECURE critical, NOSQL_INJECTION high, DEBUG_ENABLED medium,
PROTOTYPE_POLLUTION high, SSRF critical, CORS_ALL_ORIGINS high, COOKIE_INSECURE high, OPEN_REDIRECT medium,
SENSITIVE_DATA_LOG high, DANGEROUS_HTML high"""
QUALITY = """EMPTY_CATCH high, CONSOLE_LOG low, TODO_FIXME low, MAGIC_NUMBER low, TOO_MANY_PARAMS medium, DEEP_NESTING medium,
POOR_NAMING low, LONG_FUNCTION medium"""
DEVOPS = """HARDCODED_IP medium, UNHANDLED_PROMISE high, PROCESS_EXIT medium, SYNC_FILE_IN_SERVER high, MISSING_TIMEOUT medium,
NO_INPUT_VALIDATION high"""
SCALABILITY = """SEQUENTIAL_ASYNC high, N_PLUS_ONE high, NO_PAGINATION medium, NESTED_LOOP medium, STRING_CONCAT_LOOP medium,
UNBOUNDED_CACHE medium"""
SECRETS = "PASSWORD AWS_ACCESS_KEY OPENAI_API_KEY GITHUB_TOKEN GENERIC_SECRET DB_URL PRIVATE_KEY API_KEY"

# Guides by domain as id, minutes, severity, confidence.
GUIDE_TABLE = {
    "Security": """SQL_INJECTION 5 Critical CRITICAL, XSS 5 Critical CRITICAL, DANGEROUS_HTML 5 Critical CRITICAL,
COMMAND_INJECTION 7 Critical CRITICAL, AWS_ACCESS_KEY 10 Critical CRITICAL, PASSWORD 3 Critical CRITICAL, API_KEY 5 Critical CRITICAL""",
    "Quality": "CONSOLE_LOG 2 Medium HIGH, EMPTY_CATCH 5 High HIGH, TODO_FIXME 2 Low MEDIUM, MAGIC_NUMBER 2 Low MEDIUM",
    "Scalability": """N_PLUS_ONE 10 High HIGH, SEQUENTIAL_ASYNC 5 High HIGH, NO_PAGINATION 5 Medium HIGH, NESTED_LOOP 8 Medium HIGH,
UNBOUNDED_CACHE 10 Medium MEDIUM""",
    "DevOps": "UNHANDLED_PROMISE 5 High HIGH, MISSING_TIMEOUT 3 High HIGH, HARDCODED_IP 3 Medium HIGH, SENSITIVE_DATA_LOG 5 High HIGH",
}
# Gains and environment variables of guides, and what a scanner's severity counts as.
GAINS = {"N_PLUS_ONE": (0.45, 95), "SEQUENTIAL_ASYNC": (200, None)}
ENV_VARS = {"PASSWORD": "DB_PASSWORD", "API_KEY": "API_KEY"}
NORMAL = {"error": "critical", "warning": "high", "info": "medium", "critical": "critical", "high": "high", "medium": "medium", "low": "low"}


def pairs(text):
    return [tuple(x.split()) for x in text.replace("\n", " ").split(", ")]


def test_rules_and_severities():
    for domain, text, own in (("Security", SECURITY, rules.SECURITY_RULES), ("Quality", QUALITY, rules.QUALITY_RULES),
                              ("DevOps", DEVOPS, rules.DEVOPS_RULES), ("Scalability", SCALABILITY, rules.SCALABILITY_RULES)):
        assert [(r.rule_id, r.severity) for r in own] == pairs(text)
        assert {r.domain for r in own} == {domain}
    assert {r.rule_id for r in rules.SECRET_RULES} == set(SECRETS.split())
    assert {(r.severity, r.domain, r.kind) for r in rules.SECRET_RULES} == {("critical", "Security", "secret")}
    order = [r.rule_id for r in rules.ALL_RULES]
    assert [order.index(x) for x in ("SQL_INJECTION", "EMPTY_CATCH", "HARDCODED_IP", "SEQUENTIAL_ASYNC")] == [0, 25, 33, 39] and len(order) == 45


def test_guides():
    for domain, text in GUIDE_TABLE.items():
        got = [(g["rule_id"], str(g["minutes"]), g["severity"], g["confidence"]) for g in GUIDES if g["guide_domain"] == domain]
        assert got == pairs(text)
    assert {g["rule_id"]: (g["gain_ms"], g["gain_percent"]) for g in GUIDES if g["gain_ms"]} == GAINS
    assert {k: v for k, v in ((g["rule_id"], g["env_var"]) for g in GUIDES) if k in ENV_VARS} == ENV_VARS
    assert sum(bool(g["env_var"]) for g in GUIDES) == 3 and len(GUIDES) == 20


def test_explanations_cover_every_rule_and_seven_secrets():
    ids = [e["rule_id"] for e in EXPLANATIONS]
    assert len(ids) == len(set(ids)) == 44
    assert set(ids) == {r.rule_id for r in rules.ALL_RULES} - {"API_KEY"}


def test_edges_by_type():
    kinds = {}
    for _, _, kind, *_ in EDGES:
        kinds[kind] = kinds.get(kind, 0) + 1
    assert kinds == {"BLOCKS": 1, "BLOCKED_BY": 2, "CAUSED_BY": 1, "CAUSES": 2, "RELATED_TO": 14}
    ordering = {(a, b, k) for a, b, k, *_ in EDGES if k in ("BLOCKS", "DEPENDS_ON", "CAUSED_BY")}
    assert ordering == {("SEQUENTIAL_ASYNC", "N_PLUS_ONE", "BLOCKS"), ("SQL_INJECTION", "NO_INPUT_VALIDATION", "CAUSED_BY")}
    assert set(VERBS) == {"BLOCKS", "BLOCKED_BY", "DEPENDS_ON", "RELATED_TO", "CAUSES", "CAUSED_BY"}


def test_severity_tables():
    assert severity.NORMALISE == NORMAL
    assert len(severity.CRITICAL_IDS) == 5 and len(severity.HIGH_IDS) == 15 and len(severity.PINNED_SECURITY_IDS) == 13
    # the id sets name EVAL_USE and XSS where the rules emit EVAL_USAGE and XSS_INNER_HTML
    named = {*severity.CRITICAL_IDS, *severity.HIGH_IDS}
    assert "EVAL_USAGE" not in named and "XSS_INNER_HTML" not in named
    assert severity.ITERATIONS_LIMIT == 1000

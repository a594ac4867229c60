"""Dimension data: explanations (44 ids) and remediation guides (20 ids).

Prose is our own. Numbers, ids, severities and confidence levels of the
guides are fixed values and must stay as they are.
"""

from __future__ import annotations

_CWE = "https://cwe.mitre.org/data/definitions/{}.html"
_T10 = "https://owasp.org/Top10/{}/"
A01 = ("OWASP A01:2021 Broken Access Control", _T10.format("A01_2021-Broken_Access_Control"))
A02 = ("OWASP A02:2021 Cryptographic Failures", _T10.format("A02_2021-Cryptographic_Failures"))
A03 = ("OWASP A03:2021 Injection", _T10.format("A03_2021-Injection"))
A05 = ("OWASP A05:2021 Security Misconfiguration", _T10.format("A05_2021-Security_Misconfiguration"))
A07 = ("OWASP A07:2021 Identification and Authentication Failures",
       _T10.format("A07_2021-Identification_and_Authentication_Failures"))
A08 = ("OWASP A08:2021 Software and Data Integrity Failures", _T10.format("A08_2021-Software_and_Data_Integrity_Failures"))
A09 = ("OWASP A09:2021 Security Logging and Monitoring Failures",
       _T10.format("A09_2021-Security_Logging_and_Monitoring_Failures"))
A10 = ("OWASP A10:2021 Server-Side Request Forgery", _T10.format("A10_2021-Server-Side_Request_Forgery_%28SSRF%29"))
CODE = ("Maintainability", None)
OPS = ("Operability", None)
PERF = ("Performance", None)


def _x(rule_id, std, cwe, what, why, risks, bad, good, steps, docs_url=None):
    """One explanation row; `cwe` is (number, name) or a plain label."""
    if isinstance(cwe, tuple):
        cwe_name = f"CWE-{cwe[0]}: {cwe[1]}"
        cwe_url = _CWE.format(cwe[0])
    else:
        cwe_name, cwe_url = cwe, None
    url = std[1] or cwe_url or ""
    refs = [(std[0], url)] + ([(f"CWE-{cwe[0]}", cwe_url)] if isinstance(cwe, tuple) else [])
    return {
        "rule_id": rule_id,
        "what": what,
        "why": why,
        "risks": list(risks),
        "standard": {"name": std[0], "cwe_name": cwe_name, "url": url},
        "example": {"bad": bad, "good": good, "docs_url": docs_url},
        "steps": [{"order": i + 1, "title": t, "description": d, "example": e}
                  for i, (t, d, e) in enumerate(steps)],
        "refs": [{"name": n, "url": u} for n, u in refs],
    }


EXPLANATIONS = [
    _x("SQL_INJECTION", A03, (89, "SQL Injection"),
       "A SQL statement is assembled by string concatenation.",
       "Quotes in the value end the literal and the rest runs as SQL.",
       ["reads or changes of any row", "login bypass"],
       'db.run("SELECT * FROM t WHERE id = " + id)', 'db.run("SELECT * FROM t WHERE id = ?", [id])',
       [("Bind parameters", "Pass values separately from the statement text.", "db.run(sql, [id])"),
        ("Check types early", "Parse ids as numbers before they reach the query.", None)]),
    _x("EVAL_USAGE", A03, (95, "Eval Injection"),
       "eval() turns a string into running code.",
       "Whoever controls the string controls the process.",
       ["remote code execution", "data theft"],
       "eval(req.body.expr)", "JSON.parse(text)",
       [("Remove eval", "Use JSON.parse or a lookup table of allowed operations.", None),
        ("Restrict inputs", "Accept only known operation names.", None)]),
    _x("XSS_INNER_HTML", A03, (79, "Cross-site Scripting"),
       "A value is written into the page as markup via innerHTML.",
       "Markup in the value runs as script in the user's browser.",
       ["session theft", "page defacement"],
       "el.innerHTML = comment", "el.textContent = comment",
       [("Write text, not markup", "Use textContent for plain text.", None),
        ("Sanitise markup", "Run required HTML through a sanitiser first.", "DOMPurify.sanitize(html)")]),
    _x("WEAK_CRYPTO", A02, (327, "Broken or Risky Cryptographic Algorithm"),
       "MD5 or SHA-1 is used to hash data.",
       "Collisions for both are practical; they no longer protect integrity.",
       ["forged signatures", "cracked password hashes"],
       "createHash('md5')", "createHash('sha256')",
       [("Use SHA-256 or better", "Switch the hash algorithm.", None),
        ("Use a password KDF", "For passwords use bcrypt, scrypt or argon2.", None)]),
    _x("COMMAND_INJECTION", A03, (78, "OS Command Injection"),
       "A shell command is built from an interpolated template literal.",
       "Shell metacharacters in the value start extra commands.",
       ["server takeover", "data loss"],
       "exec(`convert ${file}`)", "execFile('convert', [file])",
       [("Avoid the shell", "Use execFile/spawn with an argument array.", None),
        ("Allow-list values", "Accept only expected file names or options.", None)]),
    _x("INSECURE_RANDOM", A02, (338, "Weak PRNG"),
       "Math.random() produces a security value.",
       "Its output can be predicted from earlier values.",
       ["guessable tokens", "session hijack"],
       "Math.random().toString(36)", "crypto.randomBytes(32).toString('hex')",
       [("Use the crypto RNG", "crypto.randomBytes or crypto.randomUUID.", None)]),
    _x("PATH_TRAVERSAL", A01, (22, "Path Traversal"),
       "A file path is taken from request data.",
       "Segments like ../ reach files outside the intended folder.",
       ["disclosure of secrets", "overwritten files"],
       "fs.readFile(req.query.name)", "fs.readFile(path.join(BASE, path.basename(name)))",
       [("Resolve and check", "Resolve the path and verify it stays under the base folder.", None),
        ("Use ids", "Map request ids to known files instead of taking paths.", None)]),
    _x("PASSWORD", A07, (798, "Hard-coded Credentials"),
       "A password is written into the source.",
       "Everyone with access to the code or its history has the password.",
       ["account takeover", "credential reuse"],
       'const password = "hunter2"', "const password = process.env.DB_PASSWORD",
       [("Move to configuration", "Read the password from the environment or a vault.", None),
        ("Rotate it", "Treat the committed value as leaked and change it.", None)]),
    _x("AWS_ACCESS_KEY", A07, (798, "Hard-coded Credentials"),
       "An AWS access key id is written into the source.",
       "Keys in code leak through repositories, logs and builds.",
       ["cloud resource abuse", "data exfiltration"],
       "accessKeyId: 'AKIA...'", "new S3() // credentials from the environment or role",
       [("Use roles or the environment", "Let the SDK load credentials itself.", None),
        ("Deactivate the key", "Rotate the leaked key in IAM.", None)]),
    _x("OPENAI_API_KEY", A07, (798, "Hard-coded Credentials"),
       "A model-provider API key (sk-...) is written into the source.",
       "Leaked keys are used by others at the owner's cost.",
       ["unexpected bills", "quota exhaustion"],
       "key: 'sk-...'", "key: process.env.MODEL_KEY",
       [("Move to configuration", "Read the key from the environment.", None),
        ("Rotate it", "Revoke the committed key.", None)]),
    _x("GITHUB_TOKEN", A07, (798, "Hard-coded Credentials"),
       "A GitHub token (ghp_, gho_, ghs_, ghr_) is written into the source.",
       "The token grants repository access to whoever reads it.",
       ["code theft", "malicious commits"],
       "const gh = 'ghp_...'", "const gh = process.env.GH_TOKEN",
       [("Move to configuration", "Use the CI secret store or the environment.", None),
        ("Revoke it", "Delete the token in the account settings.", None)]),
    _x("GENERIC_SECRET", A07, (798, "Hard-coded Credentials"),
       "A string literal is assigned to a secret-like name.",
       "Secrets in code spread with every copy of the code.",
       ["unauthorised access"],
       'const token = "abc..."', "const token = process.env.SERVICE_TOKEN",
       [("Move to configuration", "Load the value at run time.", None)]),
    _x("DB_URL", A07, (798, "Hard-coded Credentials"),
       "A connection URL carries a user name and password.",
       "The credentials travel with the code and its logs.",
       ["database compromise"],
       "'postgres://app:pw@db/main'", "process.env.DATABASE_URL",
       [("Move to configuration", "Read the URL from the environment.", None),
        ("Rotate the password", "Change the database password.", None)]),
    _x("PRIVATE_KEY", A02, (321, "Hard-coded Cryptographic Key"),
       "A PEM private key block is embedded in the source.",
       "Anyone holding the key can impersonate or decrypt.",
       ["impersonation", "decryption of traffic"],
       "`-----BEGIN PRIVATE KEY-----...`", "fs.readFileSync(process.env.KEY_PATH)",
       [("Store keys outside code", "Use a key store or mounted secret.", None),
        ("Replace the key", "Issue a new key pair.", None)]),
    _x("NOSQL_INJECTION", A03, (943, "Improper Neutralization of Special Elements in Data Query Logic"),
       "A query object takes request fields as they are.",
       "Objects such as {$ne: null} change the query's meaning.",
       ["login bypass", "data exposure"],
       "find({ user: req.body.user })", "find({ user: String(req.body.user) })",
       [("Coerce types", "Cast fields to strings or numbers.", None),
        ("Validate the body", "Use a schema validator.", None)]),
    _x("JWT_INSECURE", A07, (347, "Improper Verification of Cryptographic Signature"),
       "jwt.decode() reads a token without checking its signature.",
       "Any client can forge claims.",
       ["privilege escalation"],
       "jwt.decode(token)", "jwt.verify(token, key)",
       [("Verify tokens", "Use jwt.verify with the expected algorithm.", None)]),
    _x("DEBUG_ENABLED", A05, (489, "Active Debug Code"),
       "A debug flag is hard-wired to true.",
       "Debug modes expose internals and verbose errors in production.",
       ["information disclosure"],
       "{ debug: true }", "{ debug: process.env.NODE_ENV !== 'production' }",
       [("Drive it from the environment", "Derive the flag from configuration.", None)]),
    _x("PROTOTYPE_POLLUTION", A08, (1321, "Prototype Pollution"),
       "Object.assign copies request data into an object.",
       "Keys like __proto__ change every object in the process.",
       ["logic bypass", "denial of service"],
       "Object.assign(cfg, req.body)", "Object.assign(cfg, pick(req.body, ALLOWED))",
       [("Copy known keys only", "Pick allowed fields explicitly.", None),
        ("Use null-prototype objects", "Object.create(null) for maps.", None)]),
    _x("SSRF", A10, (918, "Server-Side Request Forgery"),
       "The server fetches a URL chosen by the caller.",
       "Callers reach internal services and cloud metadata.",
       ["internal network access", "credential theft"],
       "fetch(req.query.url)", "fetch(allowed(req.query.url))",
       [("Allow-list hosts", "Parse the URL and accept known hosts only.", None)]),
    _x("CORS_ALL_ORIGINS", A05, (942, "Permissive Cross-domain Policy"),
       "CORS accepts requests from every origin.",
       "Any site can call the API from a user's browser.",
       ["cross-site data reads"],
       "cors({ origin: '*' })", "cors({ origin: ['https://app.example.com'] })",
       [("List origins", "Name the origins that may call the API.", None)]),
    _x("COOKIE_INSECURE", A05, (1004, "Sensitive Cookie Without HttpOnly Flag"),
       "A cookie is set without options.",
       "Without httpOnly and secure, scripts and plain HTTP can read it.",
       ["session theft"],
       "res.cookie('sid', id)", "res.cookie('sid', id, { httpOnly: true, secure: true, sameSite: 'lax' })",
       [("Set cookie flags", "Add httpOnly, secure and sameSite.", None)]),
    _x("OPEN_REDIRECT", A01, (601, "Open Redirect"),
       "A redirect target comes from the request.",
       "Links on a trusted domain forward users to hostile sites.",
       ["phishing"],
       "res.redirect(req.query.next)", "res.redirect(safeNext(req.query.next))",
       [("Allow relative paths only", "Accept local paths or known hosts.", None)]),
    _x("SENSITIVE_DATA_LOG", A09, (532, "Sensitive Information in Log File"),
       "A credential is written to the log.",
       "Logs are widely readable and kept for long.",
       ["credential leak"],
       "console.log(password)", "log.info({ user: user.id })",
       [("Remove the value", "Log ids, never secrets.", None),
        ("Redact", "Use a logger with redaction rules.", None)]),
    _x("DANGEROUS_HTML", A03, (79, "Cross-site Scripting"),
       "React renders raw HTML without sanitising it.",
       "Markup in the value runs as script.",
       ["session theft"],
       "dangerouslySetInnerHTML={{ __html: html }}", "dangerouslySetInnerHTML={{ __html: DOMPurify.sanitize(html) }}",
       [("Sanitise", "Pass HTML through DOMPurify first.", None),
        ("Prefer text", "Render plain text where possible.", None)]),
    _x("LONG_FUNCTION", CODE, "Single responsibility",
       "A function body is very long.",
       "Long bodies hide several responsibilities and are hard to test.",
       ["bugs in changes", "slow reviews"],
       "const run = () => { /* hundreds of lines */ }", "const run = () => { load(); check(); save(); }",
       [("Extract functions", "Split the body into named steps.", None)]),
    _x("TOO_MANY_PARAMS", CODE, "Parameter object",
       "A function takes five or more parameters.",
       "Long argument lists are easy to pass in the wrong order.",
       ["argument mix-ups"],
       "function f(a, b, c, d, e) {}", "function f({ a, b, c, d, e }) {}",
       [("Introduce a parameter object", "Group related arguments.", None)]),
    _x("MAGIC_NUMBER", CODE, "Named constants",
       "An unnamed numeric literal appears in the code.",
       "Its meaning is unclear and copies drift apart.",
       ["inconsistent limits"],
       "if (n > 3600)", "const ONE_HOUR_S = 3600; if (n > ONE_HOUR_S)",
       [("Name it", "Extract a constant with a descriptive name.", None)]),
    _x("EMPTY_CATCH", CODE, (390, "Detection of Error Condition Without Action"),
       "A catch block does nothing.",
       "Failures vanish and show up later as wrong data.",
       ["silent data corruption"],
       "catch (e) { }", "catch (e) { log.error(e); throw e; }",
       [("Handle or rethrow", "Log with context, then rethrow or recover.", None)]),
    _x("CONSOLE_LOG", CODE, "Structured logging",
       "console output is left in the code.",
       "It bypasses log levels and can leak data.",
       ["noisy logs", "data leaks"],
       "console.log(user)", "log.debug({ userId: user.id })",
       [("Use a logger", "Replace console calls with a leveled logger.", None)]),
    _x("TODO_FIXME", CODE, "Tracked work",
       "A TODO/FIXME/HACK marker is left in a comment.",
       "Untracked notes are forgotten.",
       ["known bugs shipped"],
       "// TODO fix later", "// TRACKED: ISSUE-123",
       [("Track it", "Open an issue and reference it, or fix it now.", None)]),
    _x("DEEP_NESTING", CODE, "Guard clauses",
       "Control flow is nested four levels or more.",
       "Deep nesting makes paths hard to follow.",
       ["missed branches"],
       "if (a) { if (b) { if (c) { if (d) { } } } }", "if (!a) return; if (!b) return;",
       [("Return early", "Invert conditions and exit early.", None)]),
    _x("POOR_NAMING", CODE, "Meaningful names",
       "A variable has a one-letter name.",
       "Readers must guess what it holds.",
       ["misread code"],
       "let n = items.length", "let itemCount = items.length",
       [("Rename", "Use a name that says what the value is.", None)]),
    _x("HARDCODED_IP", OPS, "Externalised configuration",
       "An IP address is written into a string.",
       "Addresses change per environment and break deployments.",
       ["outages on moves"],
       "'http://10.0.0.5:8080'", "process.env.UPSTREAM_URL",
       [("Move to configuration", "Read hosts from the environment.", None)]),
    _x("MISSING_TIMEOUT", OPS, "Timeouts",
       "fetch() is awaited without a timeout.",
       "A slow peer stalls the caller indefinitely.",
       ["hung requests", "exhausted pools"],
       "await fetch(url)", "await fetch(url, { signal: AbortSignal.timeout(5000) })",
       [("Add a deadline", "Abort requests after a bounded time.", None)]),
    _x("UNHANDLED_PROMISE", OPS, (390, "Detection of Error Condition Without Action"),
       "A promise chain has no rejection handler.",
       "Unhandled rejections can end the Node.js process.",
       ["crashes"],
       "load().then(show)", "load().then(show).catch(report)",
       [("Handle rejections", "Add .catch or use try/await.", None)]),
    _x("PROCESS_EXIT", OPS, "Graceful shutdown",
       "process.exit() is called in application code.",
       "Open requests and buffers are dropped.",
       ["lost writes"],
       "process.exit(1)", "throw new Error('fatal'); // let the supervisor restart",
       [("Shut down gracefully", "Close servers and flush before exiting.", None)]),
    _x("SYNC_FILE_IN_SERVER", OPS, "Non-blocking I/O",
       "A synchronous fs call runs in server code.",
       "It blocks the event loop for every client.",
       ["latency spikes"],
       "fs.readFileSync(f)", "await fs.promises.readFile(f)",
       [("Use async I/O", "Switch to fs.promises.", None)]),
    _x("NO_INPUT_VALIDATION", A03, (20, "Improper Input Validation"),
       "Request input is used without a schema check.",
       "Unexpected shapes reach business logic and queries.",
       ["injection", "crashes"],
       "const o = req.body", "const o = Order.parse(req.body)",
       [("Validate at the edge", "Parse requests with a schema library.", None)]),
    _x("N_PLUS_ONE", PERF, "Batch loading",
       "A query runs once per loop iteration.",
       "Round trips grow with the data.",
       ["slow pages", "database load"],
       "for (u of users) await db.orders(u.id)", "await db.ordersFor(users.map(u => u.id))",
       [("Batch", "Load all rows with one IN query or a join.", None)]),
    _x("SEQUENTIAL_ASYNC", PERF, "Concurrency",
       "await inside a loop runs calls one after another.",
       "Independent calls wait for each other.",
       ["slow endpoints"],
       "for (x of xs) await f(x)", "await Promise.all(xs.map(f))",
       [("Run concurrently", "Use Promise.all, bounded if needed.", None)]),
    _x("NO_PAGINATION", PERF, "Pagination",
       "SELECT * runs without LIMIT.",
       "Result size grows with the table.",
       ["memory exhaustion"],
       "'SELECT * FROM users'", "'SELECT * FROM users LIMIT 100 OFFSET ?'",
       [("Page results", "Add LIMIT with offset or a cursor.", None)]),
    _x("NESTED_LOOP", PERF, "Hash lookups",
       "forEach is nested inside forEach.",
       "Work grows with the product of both sizes.",
       ["quadratic time"],
       "a.forEach(x => b.forEach(y => ...))", "const m = new Map(b.map(y => [y.id, y]))",
       [("Index once", "Build a Map and look up in O(1).", None)]),
    _x("STRING_CONCAT_LOOP", PERF, "String building",
       "A string grows with += inside a loop.",
       "Repeated copies make the loop quadratic.",
       ["slow exports"],
       "for (p of parts) s += p", "const s = parts.join('')",
       [("Join once", "Collect parts in an array and join.", None)]),
    _x("UNBOUNDED_CACHE", PERF, "Bounded caches",
       "A Map or Set is used as a cache without a size limit.",
       "It grows until the process runs out of memory.",
       ["memory leaks"],
       "const cache = new Map();", "const cache = new LRU({ max: 1000 })",
       [("Bound it", "Use an LRU cache with a maximum size and TTL.", None)]),
]


def _g(rule_id, domain, severity, minutes, confidence, problem, explanation, steps,
       related=(), gain_ms=None, gain_percent=None, env_var=None, bad=None, good=None):
    return {
        "rule_id": rule_id, "guide_domain": domain, "problem": problem, "explanation": explanation,
        "severity": severity, "bad": bad, "good": good, "steps": list(steps), "minutes": minutes,
        "gain_ms": gain_ms, "gain_percent": gain_percent, "env_var": env_var,
        "related": list(related) if related else None, "confidence": confidence,
    }


# ---------------------------------------------------------------------------
# Fixed values per guide: id, guide domain, severity, minutes, confidence,
# related ids, gains and env vars. Order is the reference's guide order.
# ---------------------------------------------------------------------------
# The documentation link of an explanation's example, where it has one.
DOCS_URLS = {
    "SQL_INJECTION": "https://cheatsheetseries.owasp.org/cheatsheets/SQL_Injection_Prevention_Cheat_Sheet.html",
    "EVAL_USAGE": "https://developer.mozilla.org/en-US/docs/Web/JavaScript/Reference/Global_Objects/eval#never_use_eval!",
    "XSS_INNER_HTML": "https://cheatsheetseries.owasp.org/cheatsheets/Cross_Site_Scripting_Prevention_Cheat_Sheet.html",
    "WEAK_CRYPTO": "https://cheatsheetseries.owasp.org/cheatsheets/Password_Storage_Cheat_Sheet.html",
    "COMMAND_INJECTION": "https://cheatsheetseries.owasp.org/cheatsheets/OS_Command_Injection_Defense_Cheat_Sheet.html",
    "INSECURE_RANDOM": "https://nodejs.org/api/crypto.html#cryptorandombytessize-callback",
    "PATH_TRAVERSAL": "https://cheatsheetseries.owasp.org/cheatsheets/File_Upload_Cheat_Sheet.html",
    "PASSWORD": "https://12factor.net/config",
    "AWS_ACCESS_KEY": "https://docs.aws.amazon.com/IAM/latest/UserGuide/best-practices.html",
    "OPENAI_API_KEY": "https://platform.openai.com/docs/quickstart",
    "GITHUB_TOKEN": "https://docs.github.com/en/authentication/keeping-your-account-and-data-secure/"
                    "managing-your-personal-access-tokens",
    "GENERIC_SECRET": "https://12factor.net/config",
    "DB_URL": "https://12factor.net/backing-services",
    "PRIVATE_KEY": "https://cheatsheetseries.owasp.org/cheatsheets/Cryptographic_Storage_Cheat_Sheet.html",
    "NOSQL_INJECTION": "https://cheatsheetseries.owasp.org/cheatsheets/Injection_Prevention_Cheat_Sheet.html",
    "JWT_INSECURE": "https://cheatsheetseries.owasp.org/cheatsheets/JSON_Web_Token_for_Java_Cheat_Sheet.html",
}
for _e in EXPLANATIONS:
    _e["example"]["docs_url"] = DOCS_URLS.get(_e["rule_id"])

GUIDES = [
    _g("SQL_INJECTION", "Security", "Critical", 5, "CRITICAL",
       "SQL built by concatenation", "Bind values as parameters.",
       ["Find the concatenated query", "Use placeholders", "Pass values separately", "Test with quotes"],
       related=["NO_INPUT_VALIDATION"]),
    _g("XSS", "Security", "Critical", 5, "CRITICAL",
       "Markup built from user input", "Write text, or sanitise markup.",
       ["Prefer textContent", "Sanitise required HTML", "Test with script payloads"],
       related=["DANGEROUS_HTML", "NO_INPUT_VALIDATION"],
       bad="banner.innerHTML = '<b>' + nickname + '</b>';", good="banner.textContent = nickname;"),
    _g("DANGEROUS_HTML", "Security", "Critical", 5, "CRITICAL",
       "Raw HTML rendered in React", "Sanitise before rendering.",
       ["Use text where possible", "Wrap with DOMPurify.sanitize", "Test with XSS payloads"],
       related=["XSS"]),
    _g("COMMAND_INJECTION", "Security", "Critical", 7, "CRITICAL",
       "Shell command built from input", "Call programs without a shell.",
       ["Use execFile or spawn", "Pass an argument array", "Allow-list inputs"],
       related=["NO_INPUT_VALIDATION"]),
    _g("AWS_ACCESS_KEY", "Security", "Critical", 10, "CRITICAL",
       "Cloud key pair kept in the source", "Load credentials from the environment or a role.",
       ["Deactivate the key", "Read keys from the environment", "Scan history for more keys"],
       related=["PASSWORD", "API_KEY"], env_var="AWS_ACCESS_KEY_ID, AWS_SECRET_ACCESS_KEY"),
    _g("PASSWORD", "Security", "Critical", 3, "CRITICAL",
       "Password in code", "Read it from configuration.",
       ["Move to an env var", "Rotate the password"],
       related=["API_KEY"], env_var="DB_PASSWORD"),
    _g("API_KEY", "Security", "Critical", 5, "CRITICAL",
       "API key in code", "Read it from configuration.",
       ["Move to an env var", "Revoke the key"],
       env_var="API_KEY", bad='const api_key = "q7w8...";\ncall(api_key);', good="const api_key = process.env.API_KEY;\ncall(api_key);"),
    _g("CONSOLE_LOG", "Quality", "Medium", 2, "HIGH",
       "console output in code", "Use a leveled logger.",
       ["Replace with a logger", "Drop debug output"],
       related=["SENSITIVE_DATA_LOG"]),
    _g("EMPTY_CATCH", "Quality", "High", 5, "HIGH",
       "Swallowed error", "Log and rethrow or recover.",
       ["Log with context", "Rethrow or handle"],
       related=["UNHANDLED_PROMISE"]),
    _g("TODO_FIXME", "Quality", "Low", 2, "MEDIUM",
       "Untracked TODO", "Track it or fix it.",
       ["Open an issue", "Reference it in the comment"]),
    _g("MAGIC_NUMBER", "Quality", "Low", 2, "MEDIUM",
       "Unnamed number", "Name the constant.",
       ["Extract a constant", "Reuse it"]),
    _g("N_PLUS_ONE", "Scalability", "High", 10, "HIGH",
       "Query per loop iteration", "Batch the queries.",
       ["Collect ids", "Query once with IN", "Index the result"],
       related=["SEQUENTIAL_ASYNC", "NO_PAGINATION"], gain_ms=0.45, gain_percent=95),
    _g("SEQUENTIAL_ASYNC", "Scalability", "High", 5, "HIGH",
       "Awaits in a loop", "Run independent calls concurrently.",
       ["Use Promise.all", "Bound concurrency if needed"],
       related=["N_PLUS_ONE"], gain_ms=200.0),
    _g("NO_PAGINATION", "Scalability", "Medium", 5, "HIGH",
       "Unbounded SELECT", "Page the results.",
       ["Add LIMIT", "Use a cursor"],
       related=["N_PLUS_ONE"]),
    _g("NESTED_LOOP", "Scalability", "Medium", 8, "HIGH",
       "Nested iteration", "Index one side in a Map.",
       ["Build a Map", "Look up in the loop"],
       related=["STRING_CONCAT_LOOP"]),
    _g("UNBOUNDED_CACHE", "Scalability", "Medium", 10, "MEDIUM",
       "Cache without bound", "Use an LRU with a size cap.",
       ["Pick an LRU", "Set max and TTL"]),
    _g("UNHANDLED_PROMISE", "DevOps", "High", 5, "HIGH",
       "Promise without rejection handler", "Handle rejections.",
       ["Add .catch", "Or use try/await"],
       related=["EMPTY_CATCH"]),
    _g("MISSING_TIMEOUT", "DevOps", "High", 3, "HIGH",
       "Outgoing call that may wait forever", "Abort after a deadline.",
       ["Add AbortSignal.timeout", "Retry with backoff"]),
    _g("HARDCODED_IP", "DevOps", "Medium", 3, "HIGH",
       "Address in code", "Read it from configuration.",
       ["Move to an env var"]),
    _g("SENSITIVE_DATA_LOG", "DevOps", "High", 5, "HIGH",
       "Secret in log output", "Remove or redact it.",
       ["Delete the statement", "Add redaction"],
       related=["CONSOLE_LOG", "DEBUG_ENABLED"]),
]

# A guide without a code pair of its own shows that of the explanation of its id.
_PAIRS = {e["rule_id"]: e["example"] for e in EXPLANATIONS}
for _guide in GUIDES:
    if _guide["bad"] is None and _guide["rule_id"] in _PAIRS:
        _guide["bad"], _guide["good"] = _PAIRS[_guide["rule_id"]]["bad"], _PAIRS[_guide["rule_id"]]["good"]

"""JavaScript regex -> Java / RE2 pattern text.

The rules are defined in JavaScript's regex dialect. Spark runs Java's engine
and the DuckDB oracle runs RE2; both differ from JavaScript in a few classes:

* `\\b`: ASCII in JavaScript; Unicode letters count as word characters for
  Java 17's `\\b`, so Java gets an explicit ASCII boundary.
* `\\s`: JavaScript includes Unicode blanks (no-break space, U+2000.., BOM);
  Java and RE2 cover ASCII only, so both get the JavaScript set spelled out.
* `.`: JavaScript excludes exactly \\n \\r U+2028 U+2029 (Java also U+0085).
* `^` with the `m` flag: start of text or after \\n \\r U+2028 U+2029
  (Java's multiline `^` does not match between \\r and \\n).

This rewrites tokens one by one; it is not a general regex parser.
"""

from __future__ import annotations

# JavaScript's whitespace and line-terminator sets (ECMAScript).
# Java's \s is exactly JavaScript's ASCII blanks; the Unicode ones are added.
_JS_SPACE_JAVA = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_JS_SPACE_RE2 = r"\t\n\v\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_JS_EOL_JAVA = r"\n\r\u2028-\u2029"  # as a range: single characters beyond Latin-1 make a slow class
_JS_EOL_RE2 = r"\n\r\x{2028}\x{2029}"

_ASCII_BOUNDARY_JAVA = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"  # Java's \w is ASCII
ONE_SIDED_BOUNDARIES = True  # switch for tests: the one-sided forms must match the generic one


def _is_word_literal(ch: str) -> bool:
    return ch.isascii() and (ch.isalnum() or ch == "_")


def _alternatives(body: str) -> list[str]:
    """Top-level alternatives of a group body (no nested groups or classes expected)."""
    out, cur, depth, i = [], "", 0, 0
    while i < len(body):
        c = body[i]
        if c == "\\":
            cur += body[i:i + 2]
            i += 2
            continue
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        if c == "|" and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += c
        i += 1
    return out + [cur]


def _group_after(src: str, start: int) -> str | None:
    """Body of a `(?:...)` group starting at src[start], if it is a simple one."""
    if not src.startswith("(?:", start):
        return None
    depth, i = 0, start
    while i < len(src):
        if src[i] == "\\":
            i += 2
            continue
        if src[i] == "(":
            depth += 1
        elif src[i] == ")":
            depth -= 1
            if depth == 0:
                after = src[i + 1:i + 3]
                if after[:1] in ("?", "*") or after == "{0":
                    return None  # the group may match nothing
                return src[start + 3:i]
        i += 1
    return None


def _group_before(src: str, end: int) -> str | None:
    """Body of a `(?:...)` group whose `)` is src[end]."""
    if end < 0 or src[end] != ")" or (end >= 1 and src[end - 1] == "\\"):
        return None
    depth, i = 0, end
    while i >= 0:
        c = src[i]
        escaped = i >= 1 and src[i - 1] == "\\"
        if c == ")" and not escaped:
            depth += 1
        elif c == "(" and not escaped:
            depth -= 1
            if depth == 0:
                return src[i + 3:end] if src.startswith("(?:", i) else None
        i -= 1
    return None


def _starts_word(alt: str) -> bool:
    return bool(alt) and (_is_word_literal(alt[0]) or alt[:2] in ("\\d", "\\w"))


def _ends_word(alt: str) -> bool:
    return bool(alt) and _is_word_literal(alt[-1]) and not (len(alt) >= 2 and alt[-2] == "\\")


def _boundary(src: str, at: int, target: str) -> str:
    """`\\b` at src[at:at+2]; one-sided forms when the neighbour is surely a word character.

    Before something that must start with a word character, `\\b` means "no
    word character before"; after something that must end with one, "no word
    character after".
    """
    if target != "java":
        return r"\b"
    if not ONE_SIDED_BOUNDARIES:
        return _ASCII_BOUNDARY_JAVA
    nxt = src[at + 2] if at + 2 < len(src) else ""
    grp = _group_after(src, at + 2)
    if _is_word_literal(nxt) or (grp is not None and all(_starts_word(a) for a in _alternatives(grp))):
        return r"(?<!\w)"
    prev = src[at - 1] if at >= 1 else ""
    prev_escaped = at >= 2 and src[at - 2] == "\\"
    if (_is_word_literal(prev) and not prev_escaped) or (prev_escaped and prev in "dw"):
        return r"(?!\w)"
    grp = _group_before(src, at - 1)
    if grp is not None and all(_ends_word(a) for a in _alternatives(grp)):
        return r"(?!\w)"
    # `\d{n,}` / `\d+` / `\w+` right before: the last character consumed is a word character
    import re as _re
    if _re.search(r"\\[dw](?:\+|\{[1-9]\d*,?\d*\})$", src[:at]):
        return r"(?!\w)"
    return _ASCII_BOUNDARY_JAVA


def _translate(src: str, flags: str, target: str) -> str:
    space = _JS_SPACE_JAVA if target == "java" else _JS_SPACE_RE2
    eol = _JS_EOL_JAVA if target == "java" else _JS_EOL_RE2
    multiline = "m" in flags
    out = []
    i, n = 0, len(src)
    in_class = False
    while i < n:
        c = src[i]
        if c == "\\" and i + 1 < n:
            e = src[i + 1]
            i += 2
            if e == "s":
                out.append(space if in_class else f"[{space}]")
            elif e == "S":
                if in_class:
                    raise ValueError("\\S inside a class is not supported")
                out.append(f"[^{space}]")
            elif e == "b" and not in_class:
                out.append(_boundary(src, i - 2, target))
            else:
                out.append("\\" + e)
            continue
        if in_class:
            if c == "]":
                in_class = False
            out.append(c)
            i += 1
            continue
        if c == "[":
            in_class = True
            out.append(c)
            i += 1
            if i < n and src[i] == "^":
                out.append("^")
                i += 1
            continue
        if c == ".":
            out.append(f"[^{eol}]")
        elif c == "^" and multiline:
            if target != "java":
                raise ValueError("multiline ^ has no RE2 form; write the rule's oracle by hand")
            # Java's own line starts, less the one after U+0085; Java has none at the text's end and between \r and \n,
            # where no rule matches either: each begins with a character of its line.
            out.append(r"(?m:^)(?<!\u0085)")
        else:
            out.append(c)
        i += 1
    body = "".join(out)
    if "i" in flags:
        body = "(?i)" + body
    return body


def to_java(src: str, flags: str = "") -> str:
    """Java pattern with JavaScript matching semantics."""
    return _translate(src, flags, "java")


def to_re2(src: str, flags: str = "") -> str:
    """RE2 pattern text (no lookaround support in RE2; callers check)."""
    return _translate(src, flags, "re2")


def java_pattern(rule) -> str:
    return to_java(rule.safe_pattern or rule.pattern, rule.flags)


def java_skip(rule) -> str | None:
    return to_java(rule.skip_pattern, rule.flags) if rule.skip_pattern else None

"""Rule patterns: dialect adaptation and the substrings a match must hold.

Rules are written in a linear-time regex dialect without look-around. Spark
runs ``java.util.regex``, so the few constructs that read differently are
rewritten or refused here, on the driver, once per rule set.
"""

from __future__ import annotations

import re

try:
    from re import _constants as sre
    from re import _parser as sre_parser
except ImportError:  # Python before 3.11
    import sre_constants as sre
    import sre_parse as sre_parser

# ASCII bracket classes.
BRACKET_CLASSES = {
    "alnum": "0-9A-Za-z",
    "alpha": "A-Za-z",
    "ascii": r"\x00-\x7F",
    "blank": r"\t ",
    "cntrl": r"\x00-\x1F\x7F",
    "digit": "0-9",
    "graph": "!-~",
    "lower": "a-z",
    "print": " -~",
    "punct": r"!-/:-@\[-`{-~",
    "space": r"\t\n\x0B\f\r ",
    "upper": "A-Z",
    "word": "0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
}

# ``.`` stops only at a line feed and classes are Unicode-aware.
PREFIX = "(?Ud)"

_TOKEN = re.compile(
    r"(?P<esc>\\(?:[uUx]\{[0-9A-Fa-f]+\}|[\s\S]))"
    r"|(?P<named>\(\?P?<[A-Za-z_][A-Za-z0-9_.\[\]]*>)"
    r"|(?P<flags>\(\?[A-Za-z-]+[:)])"
    r"|(?P<bracket>\[:\^?[a-z]+:\])"
    r"|(?P<any>[\s\S])"
)


# Repeats of a group up to this number may recurse.
_DEEPEST = 1000
# Characters a start guard looks back.
_LOOK_BACK = 128
_PIECE = re.compile(
    r"(?P<esc>\\[xpP]\{[^}]*\}|\\[pP][A-Za-z]|\\[\s\S])"
    r"|(?P<set>\[\^?(?:\\[\s\S]|[^\[\]\\]|\[(?:\\[\s\S]|[^\[\]\\])*\])*\])"
    r"|(?P<option>\(\?[A-Za-z-]+\))"
    r"|(?P<open>\((?:\?[A-Za-z-]*:)?)"
    r"|(?P<close>\))"
    r"|(?P<repeat>(?:[*+?]|\{(?P<low>\d+)(?P<more>,(?P<high>\d*))?\})(?P<kind>[?+]?))"
    r"|(?P<any>[\s\S])"
)
_CLASS = r"\[(?:[A-Za-z0-9._%+/=~@:-]|\\[-._+/])+\]"
_RUN = re.compile(rf"((?:\(\?[a-z]+\))?)((?:\\b)?)(?:({_CLASS})\+|({_CLASS})({_CLASS})\*)(?![?+])(?=.)", re.S)


class PatternError(ValueError):
    """The pattern cannot be run with the meaning its author intended."""


def adapt(pattern: str) -> str:
    """Equivalent ``java.util.regex`` text of a rule pattern."""
    out, depth, multiline = [], 0, False
    for m in _TOKEN.finditer(pattern):
        text = m.group()
        if m.lastgroup == "esc":
            if text[1] in "<>123456789kGQERhHX":
                raise PatternError(f"{text} is not supported in {pattern!r}")
            out.append("\\x" + text[2:] if text[1] in "uU" and text[2:3] == "{" else text)
        elif depth and m.lastgroup == "bracket":
            name = text.strip("[]:")
            if name.lstrip("^") not in BRACKET_CLASSES:
                raise PatternError(f"unknown class {text} in {pattern!r}")
            body = BRACKET_CLASSES[name.lstrip("^")]
            out.append(f"[^{body}]" if name.startswith("^") else body)
        elif depth:
            if text == "[":
                depth += 1
            elif text == "]" and out[-1] not in ("[", "[^"):
                depth -= 1
            elif text == "^" and out[-1] == "[":
                out[-1] = "[^"
                continue
            if text in "-~" and out[-1] == text:
                raise PatternError(f"class set operation {text * 2} in {pattern!r}")
            # A leading ] is literal.
            out.append("\\]" if text == "]" and out[-1] in ("[", "[^") else text)
        elif m.lastgroup == "named":
            out.append("(?:")
        elif m.lastgroup == "flags":
            on, _, off = text[2:-1].partition("-")
            if set(on + off) - set("imsx"):
                raise PatternError(f"flag group {text} in {pattern!r}")
            multiline |= "m" in on
            out.append(text)
        elif text == "[" or m.lastgroup == "bracket":
            depth += 1
            out.append("[")
            if len(text) > 1:
                raise PatternError(f"bracket class outside of a class in {pattern!r}")
        elif text == "$" and not multiline:
            out.append("\\z")
        else:
            out.append(text)
    java = "".join(out)
    parsed = _parse(_readable(java))
    if parsed is None:
        raise PatternError(f"{pattern!r} cannot be read")
    if parsed.getwidth()[0] == 0:
        raise PatternError(f"{pattern!r} matches the empty text")
    return _start_once(_bounded_recursion(java, pattern))


def _readable(java: str) -> str:
    """The pattern with what Python spells otherwise, for questions about its width."""
    java = re.sub(r"\\[pP](?:\{[^}]*\}|[A-Za-z])", r"\\w", java)
    java = re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", java)
    return re.sub(r"\(\?[A-Za-z-]+\)", "", java.replace("\\z", "\\Z"))


def _bounded_recursion(java: str, pattern: str) -> str:
    """Refuse repeats that take a stack frame for each round.

    Those are long repeats of groups of varying length or with alternatives. As
    the last part of a pattern such a repeat never gives a round back, so it
    may be possessive, which runs as a loop.
    """
    varies, closed, last = [False], None, len(java)
    for m in _PIECE.finditer(java):
        kind, closed_before, closed = m.lastgroup, closed, None
        if kind == "open":
            varies.append(False)
        elif kind == "close":
            closed = varies.pop() if len(varies) > 1 else None
            varies[-1] |= bool(closed)
        elif kind == "repeat" or m["repeat"]:
            sign = m["repeat"][0]
            low = int(m["low"] or 0) if sign == "{" else int(sign == "+")
            high = {"*": None, "+": None, "?": 1}.get(sign, low)
            if sign == "{" and m["more"]:
                high = int(m["high"]) if m["high"] else None
            if closed_before and (high is None or high > _DEEPEST) and m["kind"] != "+":
                if m.end() < last or len(varies) > 1 or low > 1 or m["kind"]:
                    raise PatternError(f"long repeat of a group of varying length in {pattern!r}")
                java += "+"
            varies[-1] |= low != high
        elif m.group() == "|":
            varies[-1] = True
    return java


def _start_once(java: str) -> str:
    """Let a pattern that begins with a long run of a class start once in each run.

    A match that starts inside a run also matches from an earlier start in it, unless the match
    before ends between the two. Without the guard each place of a run is tried, and a run
    costs the square of its length.
    """
    m = _RUN.match(java)
    if not m:
        return java
    flags, edge, run, head, rest = m.groups()
    head, rest = head or run, rest or run
    if any(re.match(head, chr(c)) and not re.match(rest, chr(c)) for c in range(128)):
        return java
    if not edge and head == rest:
        guard = rf"(?:\G|(?<!{rest}))"
    else:
        earlier = rf"(?<!{edge}{head}{rest}{{0,{_LOOK_BACK}}})"
        guard = rf"(?={head})(?:(?<!{rest})|{earlier}|(?<=\G{rest}{{0,{_LOOK_BACK}}}))"
    return flags + edge + guard + java[m.end(2) :]


def quote(literal: str) -> str:
    """The literal as a pattern."""
    return "".join("\\" + c if c.isascii() and not c.isalnum() else c for c in literal)


def _parse(pattern: str):
    # A leading flag group is moved into a flags argument by the parser itself.
    try:
        return sre_parser.parse(pattern)
    except (re.error, RecursionError, OverflowError):
        return None


def ignores_case(pattern: str) -> bool:
    return any("i" in m.group().partition("-")[0] for m in re.finditer(r"\(\?[A-Za-z-]+[:)]", pattern))


def required_substrings(pattern: str, limit: int = 2) -> list[frozenset[str]]:
    """Up to ``limit`` sets, each holding a substring of every match.

    Substrings are lower case when the pattern ignores case. An empty result
    means nothing is known and the pattern must always run.
    """
    parsed = _parse(pattern)
    if parsed is None:
        return []
    clauses = _clauses(parsed)
    if ignores_case(pattern):
        clauses = [frozenset(s.lower() for s in c) for c in clauses]
    ranked = sorted(set(clauses), key=lambda c: (-min(map(len, c)), len(c), sorted(c)))
    return ranked[:limit]


def _clauses(sequence) -> list[frozenset[str]]:
    out: list[frozenset[str]] = []
    run = ""

    def flush():
        nonlocal run
        if run:
            out.append(frozenset([run]))
        run = ""

    for op, arg in sequence:
        if op is sre.LITERAL and arg < 128:
            run += chr(arg)
            continue
        flush()
        if op is sre.IN:
            members = [a for o, a in arg if o is sre.LITERAL and a < 128]
            if len(members) == len(arg) <= 8:
                out.append(frozenset(map(chr, members)))
        elif op is sre.BRANCH:
            best = [_best(_clauses(branch)) for branch in arg[1]]
            if all(best):
                out.append(frozenset().union(*best))
        elif op is sre.SUBPATTERN:
            out.extend(_clauses(arg[-1]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            out.extend(_clauses(arg[2]))
    flush()
    return out


def _best(clauses: list[frozenset[str]]) -> frozenset[str] | None:
    if not clauses:
        return None
    return min(clauses, key=lambda c: (-min(map(len, c)), len(c)))

r"""Search patterns: from a linear-time regular expression dialect to Java's.

The dialect has no look-around, back-references, atomic groups or possessive
quantifiers; classes and boundaries are Unicode; ``.`` excludes only ``\n``; and
``$`` without the m flag is the end of the text alone. Java accepts more and
differs in all of these, so a pattern is read item by item: what the dialect
lacks is refused as InvalidPattern, what Java spells differently is rewritten,
and the flags d (lines end with ``\n``) and U (Unicode classes) are put in front.
Java matches by backtracking, so hostile patterns can be slow; literal searches
never are.
"""

from __future__ import annotations

import re

from rowlens.model import FilterSpec, InvalidPattern

#: ASCII classes that the dialect writes [[:name:]].
POSIX = {
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
    "word": "0-9A-Z_a-z",
    "xdigit": "0-9A-Fa-f",
}
_SIMPLE = set("dDsSwWbBAztnrfa")
_CATEGORY = re.compile(r"L[CultmoU]?|M[nce]?|N[dlo]?|P[cdseifo]?|S[mcko]?|Z[slp]?|C[cfsont]?")
_GROUP = re.compile(r"\?P?<([A-Za-z_][A-Za-z0-9_]*)>")
_FLAGS = re.compile(r"\?([a-zA-Z]*)(?:-([a-zA-Z]+))?([:)])")
_COUNT = re.compile(r"\{(\d+)(,\d*)?\}")


class _Reader:
    def __init__(self, pattern: str):
        self.s = pattern
        self.i = 0
        self.names: dict[str, str] = {}

    def fail(self, why: str) -> InvalidPattern:
        return InvalidPattern(f"{why} at {self.i} in {self.s!r}")

    def escape(self, in_class: bool) -> str:
        self.i += 1
        if self.i >= len(self.s):
            raise self.fail("nothing after a backslash")
        c = self.s[self.i]
        self.i += 1
        if c in "xuU":
            if m := re.compile(r"\{([0-9A-Fa-f]+)\}").match(self.s, self.i):
                digits = m[1]
            else:
                m = re.compile(r"[0-9A-Fa-f]{%d}" % {"x": 2, "u": 4, "U": 8}[c]).match(self.s, self.i)
                digits = m[0] if m else ""
            if not digits or int(digits, 16) > 0x10FFFF:
                raise self.fail("no such character")
            self.i = m.end()
            return rf"\x{{{digits.lstrip('0') or '0'}}}"
        if c in "pP":
            m = re.compile(r"\{(\^?)([^}]*)\}|([A-Z])").match(self.s, self.i)
            if not m:
                raise self.fail("no class name")
            self.i = m.end()
            name = (m[2] or m[3] or "").replace(" ", "").replace("-", "_")
            if "=" in name or ":" in name:
                name = re.split("[=:]", name)[-1]
            negated = (c == "P") != bool(m[1])
            if not re.fullmatch(r"\w+", name):
                raise self.fail("no class name")
            return rf"\{'P' if negated else 'p'}{{{name if _CATEGORY.fullmatch(name) else 'Is' + name}}}"
        if c == "v":
            return r"\x{B}"
        if c in "<>" and not in_class:
            return r"\b(?=\w)" if c == "<" else r"\b(?<=\w)"
        if c == "b" and not in_class and self.s.startswith("{", self.i):
            raise self.fail("this word boundary is not supported")
        if c in _SIMPLE and not (in_class and c in "bBAz"):
            return "\\" + c
        if c.isalnum():
            raise self.fail("no such escape")
        return "\\" + c

    def klass(self) -> str:
        self.i += 1
        out = "["
        if self.s.startswith("^", self.i):
            out, self.i = "[^", self.i + 1
        first = True
        while True:
            if self.i >= len(self.s):
                raise self.fail("a class isn't closed")
            c = self.s[self.i]
            if c == "]" and not first:
                self.i += 1
                return out + "]"
            first = False
            if c == "[":
                if m := re.compile(r"\[:(\^?)(\w+):\]").match(self.s, self.i):
                    if m[2] not in POSIX:
                        raise self.fail("no such class")
                    out += f"[{m[1]}{POSIX[m[2]]}]"
                    self.i = m.end()
                else:
                    out += self.klass()
            elif c == "\\":
                out += self.escape(True)
            elif self.s.startswith("&&", self.i):
                out, self.i = out + "&&", self.i + 2
            elif self.s.startswith(("--", "~~"), self.i) and not self.s.startswith("--]", self.i):
                raise self.fail("class differences are not supported")
            else:
                out += "\\" + c if c in "]&^#" else c
                self.i += 1

    def group(self, multi: bool) -> tuple[str, bool, bool]:
        """What opens here: its text, the m flag inside, and whether it is a group (not just flags)."""
        self.i += 1
        if not self.s.startswith("?", self.i):
            return "(", multi, True
        if m := _GROUP.match(self.s, self.i):
            if m[1] in self.names:
                raise self.fail("a group name is used twice")
            self.names[m[1]] = f"g{len(self.names)}x"  # Java's names have no underscores
            self.i = m.end()
            return f"(?<{self.names[m[1]]}>", multi, True
        if not (m := _FLAGS.match(self.s, self.i)) or not (m[1] or m[2] or m[3] == ":"):
            raise self.fail("this group is not supported")
        if set(m[1] + (m[2] or "")) - set("imsx"):
            raise self.fail("this flag is not supported")
        self.i = m.end()
        if "x" in m[1]:
            raise self.fail("the x flag is not supported")
        multi = "m" in m[1] or multi and "m" not in (m[2] or "")
        on, off = m[1].replace("i", "iu"), (m[2] or "").replace("x", "").replace("i", "iu")
        return f"(?{on}{'-' + off if off else ''}{m[3]}", multi, m[3] == ":"

    def read(self) -> str:
        out: list[str] = []
        flags: list[bool] = [False]
        repeatable = False
        while self.i < len(self.s):
            c = self.s[self.i]
            if c == "(":
                text, multi, opens = self.group(flags[-1])
                out.append(text)
                if opens:
                    flags.append(multi)
                else:
                    flags[-1] = multi
                repeatable = False
            elif c == ")":
                if len(flags) == 1:
                    raise self.fail("a group is closed that isn't open")
                flags.pop()
                out.append(c)
                self.i += 1
                repeatable = True
            elif c in "*+?" or c == "{":
                m = _COUNT.match(self.s, self.i) if c == "{" else None
                if not repeatable or c == "{" and not m:
                    raise self.fail("nothing to repeat")
                if m and m[2] and len(m[2]) > 1 and int(m[2][1:]) < int(m[1]):
                    raise self.fail("a count that ends before it begins")
                text = m[0] if m else c
                self.i += len(text)
                if self.s.startswith("?", self.i):
                    text, self.i = text + "?", self.i + 1
                # a second quantifier repeats the first, where Java would read a possessive one
                if self.i < len(self.s) and self.s[self.i] in "*+?{":
                    raise self.fail("a repeated quantifier is not supported")
                out.append(text)
                repeatable = False
                continue
            elif c == "[":
                out.append(self.klass())
                repeatable = True
            elif c == "\\":
                out.append(self.escape(False))
                repeatable = True
            else:
                out.append(r"\z" if c == "$" and not flags[-1] else "\\" + c if c in "}]#" else c)
                self.i += 1
                repeatable = c not in "|^$"
        if len(flags) > 1:
            raise self.fail("a group isn't closed")
        return "".join(out)


def translate(pattern: str, case_sensitive: bool = False) -> str:
    """The Java pattern, or InvalidPattern."""
    return f"(?dU{'' if case_sensitive else 'iu'}){_Reader(pattern).read()}"


def literal(query: str, case_sensitive: bool = False) -> str:
    """A Java pattern for the query as it stands."""
    quoted = "\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return quoted if case_sensitive else "(?iu)" + quoted


def compile_filter(spec: FilterSpec, spark=None) -> str:
    """The Java pattern of a filter. With a session, Java itself checks it, too."""
    if not spec.regex:
        return literal(spec.query, spec.case_sensitive)
    pattern = translate(spec.query, spec.case_sensitive)
    jvm = getattr(getattr(spark, "sparkContext", None), "_jvm", None)
    if jvm is not None:
        from py4j.protocol import Py4JJavaError

        try:
            jvm.java.util.regex.Pattern.compile(pattern)
        except Py4JJavaError as e:
            raise InvalidPattern(f"{spec.query!r}: {e.java_exception.getMessage()}") from None
    return pattern

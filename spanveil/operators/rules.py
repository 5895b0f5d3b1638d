"""Detection rules: rows of (label, pattern) tried in order.

A match takes the whole value: runs of letters and digits have no upper bound,
so no tail of a longer value is left unmasked. Matching stays linear without
bounds because an open-ended piece can start at the start of its run only (a
lookbehind tells, or ``\\G`` right after a match) and never gives characters
back (possessive), so each run is read once and needs no deep stack.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import regex

# The default entity labels, in their published order.
DEFAULT_TYPES = (
    "TIME", "USERNAME", "IDCARD", "SOCIALNUMBER", "EMAIL", "PASSPORT",
    "DRIVERLICENSE", "DOB", "LASTNAME1", "IP", "GIVENNAME1", "SEX",
    "TEL", "CITY", "POSTCODE", "STREET", "STATE", "BUILDING", "TITLE",
    "COUNTRY", "DATE", "PASS", "SECADDRESS", "LASTNAME2", "GIVENNAME2",
    "GEOCOORD", "LASTNAME3",
)


@dataclass(frozen=True)
class Rule:
    """One detection rule.

    ``cue`` matches words that must stand right before the entity and stay
    unmasked. ``needs`` holds groups of lower-case literals; every match, put in
    lower case, contains at least one literal of each group. A text that cannot
    meet this skips the rule without running its pattern. ``starts`` holds bodies of character classes, for the
    first characters a match can have, a hyphen last in each; other places in
    the text are passed over after one test. Both only save time. Neither pattern may contain a
    capturing group, and ``pattern`` must not match the empty string; such rules
    are refused.
    """

    label: str
    pattern: str
    cue: str = ""
    needs: tuple[tuple[str, ...], ...] = ()
    starts: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        compiled = regex.compile(f"(?:{self.cue})(?:{self.pattern})")
        if compiled.groups:
            raise ValueError(f"rule {self.label}: write (?:...) for a group, a plain one is not allowed")
        if regex.compile(self.pattern).match(""):
            raise ValueError(f"rule {self.label}: the pattern matches the empty string")

    @property
    def whole(self) -> str:
        return f"(?:{self.cue})(?:{self.pattern})" if self.cue else f"(?:{self.pattern})"


_MONTH = (
    "(?:January|February|March|April|May|June|July|August|September|October|November|December"
    "|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec)"
)
_DIGITS = "(?<![0-9])[0-9]"  # the first digit of a run
_DATE = (
    f"{_DIGITS}++[-/.][0-9]{{1,2}}[-/.][0-9]{{2,}}+"
    f"|{_DIGITS}{{4,}}+[-/][0-9]{{1,2}}[-/][0-9]++"
    f"|{_DIGITS}++(?:st|nd|rd|th)? {_MONTH},? [0-9]{{4,}}+"
    f"|{_MONTH} [0-9]++(?:st|nd|rd|th)?(?:,? [0-9]{{4,}}+)?"
)
_GAP = "[ ]{0,3}"
_SIGN = f"{_GAP}[:=#]{_GAP}"
_SIGNS = (":", "=", "#")

# Letters of any script, so that no head or tail of a value is left.
_LETTER, _ALNUM = r"\p{L}\p{M}", r"\p{L}\p{M}\p{N}"
# A code holds a digit, or is in capitals; it goes on to the end of its letters, digits and hyphens.
_CODE = rf"[{_LETTER}-]*+\p{{N}}[{_ALNUM}-]*+|[A-Z][A-Z-]{{4,}}+[{_ALNUM}-]*+"

DEFAULT_RULES = (
    Rule("EMAIL", rf"(?:\G|(?<![{_ALNUM}._%+-]))[{_ALNUM}._%+-]++@[{_ALNUM}.-]+\.[{_LETTER}]{{2,}}[{_ALNUM}-]*+",
         needs=(("@",),), starts=(f"{_ALNUM}._%+-",)),
    Rule("GEOCOORD", rf"[-+]?{_DIGITS}++\.[0-9]{{3,}}+,[ ]?[-+]?[0-9]++\.[0-9]{{3,}}+", starts=("0-9+-",)),
    Rule("IP", rf"{_DIGITS}++(?:\.[0-9]++){{3,}}+", starts=("0-9",)),
    Rule("TEL", rf"(?:\+[0-9]{{1,3}}[ .-])?{_DIGITS}{{3,}}+[ .-][0-9]{{3}}[ .-][0-9]{{4,}}+"
         r"|\+[0-9]{4,}+[ .-][0-9]{3}[ .-][0-9]{4,}+"
         r"|(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ ]?[0-9]{3}[ .-][0-9]{4,}+",
         starts=("0-9+(",)),
    Rule("SOCIALNUMBER", f"{_DIGITS}{{3,}}+-[0-9]{{2}}-[0-9]{{4,}}+", starts=("0-9",)),
    Rule("DATE", _DATE, starts=("0-9JFMASOND",)),
    Rule("TIME", f"{_DIGITS}++:[0-9]{{2,}}+(?::[0-9]++)*+(?:[ ]?[AaPp][Mm])?", starts=("0-9",)),
    Rule("TITLE", r"(?:Mrs|Mr|Ms|Dr|Prof)\.", starts=("MDP",)),
    Rule("DOB", _DATE, cue=f"(?i:date of birth|birth date|dob|born){_SIGN}",
         needs=(_SIGNS, ("birth", "dob", "born")), starts=("DdBb", "AaIiOo")),
    # A secret may hold any sign: it is the run of all that is no white space, but for commas, semicolons and quotes at its end.
    Rule("PASS", r"[^\x09-\x0D\x20\x85\p{Z}]{3,}[^\x09-\x0D\x20\x85\p{Z},;\"']",
         cue=f"(?i:password|passcode|passwd|pwd|secret|token|api[_-]?key){_SIGN}[\"']?",
         needs=(_SIGNS, ("passw", "passcode", "pwd", "secret", "token", "apikey", "api_key", "api-key")),
         starts=("PpSsTtAa", "AaWwEeOoPp")),
    Rule("PASSPORT", _CODE, cue=f"(?i:passport)(?i:[ ]number|[ ]no\\.?)?{_SIGN}",
         needs=(_SIGNS, ("passport",)), starts=("Pp", "Aa")),
    Rule("IDCARD", _CODE, cue=f"(?i:identity card|id card|national id){_SIGN}",
         needs=(_SIGNS, ("identity card", "id card", "national id")), starts=("IiNn", "DdAa")),
    Rule("DRIVERLICENSE", _CODE,
         cue=f"(?i:driver'?s? licen[cs]e|driving licen[cs]e){_SIGN}",
         needs=(_SIGNS, ("licence", "license")), starts=("Dd", "Rr")),
    Rule("USERNAME", rf"[\p{{L}}\p{{N}}][{_ALNUM}._@+-]++", cue=f"(?i:user ?name|user|login|handle){_SIGN}",
         needs=(_SIGNS, ("user", "login", "handle")), starts=("UuLlHh", "SsOoAa")),
    Rule("POSTCODE", rf"[{_ALNUM}]{{3,}}+(?:-[{_ALNUM}-]++| [A-Za-z0-9]{{3,4}}(?![A-Za-z0-9_]))?",
         cue=f"(?i:zip code|zip|post ?code|postal code){_SIGN}", needs=(_SIGNS, ("zip", "post")), starts=("ZzPp", "IiOo")),
    Rule("SEX", "(?i:female|male|non-binary|diverse)(?![A-Za-z0-9_])", cue=f"(?i:sex|gender){_SIGN}",
         needs=(_SIGNS, ("sex", "gender")), starts=("SsGg", "Ee")),
)

# Patterns with many false hits; pass DEFAULT_RULES + BROAD_RULES to use them.
BROAD_RULES = (
    Rule("STREET", f"{_DIGITS}++ [A-Z][a-z]++ (?:Street|Avenue|Road|Lane|Drive|Boulevard|St|Ave|Rd|Ln|Blvd)",
         starts=("0-9",)),
    Rule("BUILDING", "(?:Building|Bldg|House|Tower) [A-Z0-9]++", starts=("BHT",)),
    Rule("SECADDRESS", "(?:Apartment|Apt|Suite|Unit|Flat)[.]? #?[A-Z0-9]++", starts=("ASUF",)),
)


def select_rules(types: Sequence[str] | None, rules: Iterable[Rule] = DEFAULT_RULES) -> tuple[Rule, ...]:
    """The rules whose label is in ``types``, in rule order; all when None.

    An empty list selects nothing. A type without a rule is legal: a lookup or
    a caller's model may cover it.
    """
    if types is None:
        return tuple(rules)
    wanted = set(types)
    return tuple(r for r in rules if r.label in wanted)

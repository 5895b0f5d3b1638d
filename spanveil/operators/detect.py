"""Rule detection and masking as column expressions.

A text becomes an array of segments ``(piece, label)``; the label is null for
plain text. Joining the pieces gives the text back, joining them with
``[LABEL]`` in place of the labelled ones gives the masked text, and prefix
sums of their lengths give the offsets. Everything happens inside the row:
no shuffle, no Python worker, and the same plan runs on a stream.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.functions.arrays import bind, running_total
from spanveil.functions.spans import NO_SPANS, span
from spanveil.functions.text import name, quoted
from spanveil.operators.rules import DEFAULT_RULES, Rule, select_rules

# Two Unicode noncharacters, reserved for use inside a program. MARK fences a
# match, SLOT separates the rule slots inside the fence. Where a text does hold
# one of them, it counts as plain text and no entity reaches across it.
MARK = "\ufdd0"
SLOT = "\ufdd1"


def segment(piece: str, label: str = "CAST(NULL AS STRING)") -> str:
    return f"named_struct('piece', {piece}, 'label', {label})"


def _contains_any(text: str, literals: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(x)})" for x in literals) + ")"


def holds_reserved(text: str) -> str:
    return _contains_any(text, (MARK, SLOT))


def _gate(rule: Rule) -> str:
    return "" if not rule.needs else "cue" if rule.cue else "literal"


def _guard(starts: Sequence[Sequence[str]]) -> str:
    """A lookahead for the first characters that all the rules have in common."""
    classes = []
    for bodies in zip(*starts):
        # One flat class is faster than a union; a closing hyphen moves to its end.
        hyphen = "-" if any(b.endswith("-") for b in bodies) else ""
        classes.append("[" + "".join(dict.fromkeys(b.removesuffix("-") for b in bodies)) + hyphen + "]")
    return f"(?={''.join(classes)})" if classes else ""


def _gate_test(text: str, rules: Sequence[Rule]) -> str:
    """True when some rule's required literals all occur in the text.

    Literals without letters are looked for first, in the text as it is; the
    text is put in lower case only if they leave something to decide.
    """
    by_signs: dict[tuple, dict[tuple, None]] = {}
    for rule in rules:
        signs = tuple(g for g in rule.needs if all(x.lower() == x.upper() for x in g))
        words = tuple(g for g in rule.needs if g not in signs)
        by_signs.setdefault(signs, {})[words] = None
    tests = []
    for signs, alternatives in by_signs.items():
        parts = [_contains_any(text, group) for group in signs]
        if () not in alternatives:
            met = [" AND ".join(_contains_any("low", group) for group in words) for words in alternatives]
            parts.append(bind(f"lower({text})", "low", " OR ".join(f"({m})" for m in met)))
        tests.append("(" + " AND ".join(parts) + ")")
    return " OR ".join(tests)


def _fence(text: str, rules: Sequence[Rule], open_gates: Iterable[str]) -> str:
    """One regex pass that fences each match of the rules behind open gates.

    A match turns into ``cue MARK slot0 SLOT slot1 ... MARK`` in which only the
    slot of the rule that matched is filled, so the slot number gives the label
    and no second pattern has to run.
    """
    branches, cues, slots, group = [], [], [], 0
    for gate, neighbours in groupby(rules, key=_gate):
        members = list(neighbours)
        if gate not in open_gates:
            slots += [""] * len(members)
            continue
        alternatives = []
        for rule in members:
            if rule.cue:
                alternatives.append(f"({rule.cue})({rule.pattern})")
                cues.append(f"${group + 1}")
                group += 2
            else:
                alternatives.append(f"({rule.pattern})")
                group += 1
            slots.append(f"${group}")
        guard = _guard([r.starts for r in members])
        branches.append(f"{guard}(?:{'|'.join(alternatives)})")
    if not branches:
        return text
    fenced = "".join(cues) + MARK + SLOT.join(slots) + MARK
    return f"regexp_replace({text}, {quoted('|'.join(branches))}, {quoted(fenced)})"


def _label_slots(fenced: str, rules: Sequence[Rule]) -> str:
    """Fenced text to segments: text at even, filled slots at odd places."""
    labels = "array(" + ", ".join(quoted(r.label) for r in rules) + ")"
    slot = f"get({labels}, length(p) - length(ltrim({quoted(SLOT)}, p)))"
    match = segment(f"replace(p, {quoted(SLOT)}, '')", slot)
    return f"transform(split({fenced}, {quoted(MARK)}, -1), (p, i) -> if(i % 2 = 0, {segment('p')}, {match}))"


def with_segments(df: DataFrame, text_col: str, rules: Sequence[Rule]) -> DataFrame:
    """Append ``_segments``, the text cut at the matches of ``rules``.

    Rules whose required literals do not occur in a text are left out of its
    pattern: a literal search costs a small part of a regex pass. There are two
    such gates, for rules with and without cue words, hence at most four
    patterns, all with the same result on the texts they see.
    """
    text = name(text_col)
    if not rules:
        return df.select("*", F.expr(f"array({segment(text)})").alias("_segments"))

    gates = sorted({_gate(r) for r in rules} - {""})
    every = ["", *gates]
    # A projection each for gates and fences, so that they are computed once.
    flags = [F.expr(_gate_test(text, [r for r in rules if _gate(r) == g])).alias(f"_gate_{g}") for g in gates]
    staged = df.select("*", *flags) if gates else df

    # From no gate open to all but one; the first case that holds is taken.
    fenced = _fence(text, rules, every)
    cases = []
    for opened in [*([[]] if gates else []), *([g] for g in gates if len(gates) > 1)]:
        shut = " AND ".join(f"NOT _gate_{g}" for g in gates if g not in opened)
        cases.append(f"WHEN {shut} THEN {_fence(text, rules, ['', *opened])}")
    if cases:
        fenced = f"CASE {' '.join(cases)} ELSE {fenced} END"

    around_reserved = (
        f"flatten(transform(split({text}, {quoted(f'(?<=[{MARK}{SLOT}])|(?=[{MARK}{SLOT}])')}, -1), "
        f"part -> if({holds_reserved('part')}, array({segment('part')}), "
        f"{_label_slots(_fence('part', rules, every), rules)})))"
    )
    segments = (
        f"CASE WHEN {holds_reserved(text)} THEN {around_reserved} "
        f"WHEN contains(_fenced, {quoted(MARK)}) THEN {_label_slots('_fenced', rules)} "
        f"WHEN {text} IS NOT NULL THEN array({segment(text)}) END"
    )
    fenced_df = staged.select("*", F.expr(fenced).alias("_fenced")).drop(*(f"_gate_{g}" for g in gates))
    return fenced_df.select("*", F.expr(segments).alias("_segments")).drop("_fenced")


def masked_text(segments: str) -> str:
    """SQL text of the masked form of a segment array."""
    return f"array_join(transform({segments}, s -> if(s.label IS NULL, s.piece, concat('[', s.label, ']'))), '')"


def segment_spans(segments: str) -> str:
    """SQL text of the entity spans of a segment array, in text order."""
    ends = running_total(f"transform({segments}, s -> length(s.piece))")
    placed = span("s.label", "s.piece", "get(ends, i) - length(s.piece)", "get(ends, i)")
    located = bind(ends, "ends", f"transform({segments}, (s, i) -> {placed})")
    return f"filter({located}, s -> s.label IS NOT NULL)"


def add_redaction(df: DataFrame) -> DataFrame:
    """Replace ``_segments`` by ``redacted_text`` and ``pii_entities``."""
    spans = f"if(exists(_segments, s -> s.label IS NOT NULL), {segment_spans('_segments')}, {NO_SPANS})"
    return (
        df.drop("redacted_text", "pii_entities")
        .select(
            "*",
            F.expr(masked_text("_segments")).alias("redacted_text"),
            F.expr(f"coalesce({spans}, {NO_SPANS})").alias("pii_entities"),
        )
        .drop("_segments")
    )


def redact(
    df: DataFrame,
    text_col: str = "text",
    types: Sequence[str] | None = None,
    rules: Iterable[Rule] = DEFAULT_RULES,
) -> DataFrame:
    """Mask the entities of ``text_col``.

    Adds ``redacted_text`` and ``pii_entities``. ``types`` limits detection to
    the given labels; ``rules`` may hold the caller's own. A null text gives a
    null masked text and no entities.
    """
    return add_redaction(with_segments(df, text_col, select_rules(types, rules)))

"""Entities from an original text and its masked form.

The masked text is cut at its placeholders. Between two of them both texts run
in step, so a placeholder's entity starts where the previous one ended plus the
length of the plain text between. It reaches up to the first place at which the
character that follows the placeholder occurs, or to the end of the text. That
end is needed for the next start, so the walk is a fold over the placeholders
of one row; rows need no exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.functions.arrays import bind
from spanveil.functions.spans import NO_SPANS, SPANS_DDL, span
from spanveil.functions.text import name, quoted

# Placeholder names without digits: GIVENNAME1 and the like do not count by default.
PLACEHOLDER = "[A-Z]+"

# The walk runs in blocks of sqrt(k) placeholders, at least this many. A step
# searches and appends only within its block's share of the text, and only the
# start of a block copies the rest of the text, so a text with n characters and
# k placeholders costs about n * sqrt(k) instead of n * k.
SMALLEST_BLOCK = 16


def _steps(redacted: str, placeholder: str) -> str:
    """Per placeholder: label, plain characters before it, the character after it."""
    names = f"regexp_extract_all({redacted}, {quoted(rf'\[({placeholder})\]')}, 1)"
    plain = f"split({redacted}, {quoted(rf'\[{placeholder}\]')}, -1)"
    follower = (
        "CASE WHEN get(cut.plain, k + 1) <> '' THEN left(get(cut.plain, k + 1), 1) "
        "WHEN k + 1 < size(cut.names) THEN '[' ELSE '' END"
    )
    step = f"named_struct('label', label, 'gap', length(get(cut.plain, k)), 'follower', {follower})"
    return bind(
        f"named_struct('names', {names}, 'plain', {plain})", "cut", f"transform(cut.names, (label, k) -> {step})"
    )


def _walk_block(steps: str, rest: str, base: str) -> str:
    """Walk some steps over ``rest``, the text from offset ``base`` on."""
    value = f"substring({rest}, here.start + 1, greatest(here.end - here.start, 0))"
    found = span("s.label", value, f"{base} + here.start", f"{base} + here.end")
    after = f"named_struct('at', here.end, 'spans', concat(walked.spans, array({found})))"
    hit = f"if(s.follower = '', 0, position(s.follower, {rest}, walked.at + s.gap + 1))"
    end = bind(hit, "hit", f"if(hit > 0, hit - 1, length({rest}))")
    step = bind(f"named_struct('start', walked.at + s.gap, 'end', {end})", "here", after)
    return f"aggregate({steps}, named_struct('at', 0, 'spans', {NO_SPANS}), (walked, s) -> {step})"


def align_spans(original: str, redacted: str, placeholder: str = PLACEHOLDER) -> str:
    """SQL text of the entity spans of ``original``."""
    block = _walk_block("slice(all.steps, b * all.width + 1, all.width)", "state.rest", "state.base")
    after = (
        "named_struct('base', state.base + done.at, "
        "'rest', substring(state.rest, done.at + 1), "
        "'blocks', concat(state.blocks, array(done.spans)))"
    )
    start = f"named_struct('base', 0, 'rest', {original}, 'blocks', CAST(array() AS ARRAY<{SPANS_DDL}>))"
    walk = (
        f"aggregate(sequence(0, (size(all.steps) - 1) div all.width), {start}, "
        f"(state, b) -> {bind(block, 'done', after)}, state -> flatten(state.blocks))"
    )
    width = f"greatest({SMALLEST_BLOCK}, CAST(sqrt(size(steps)) AS INT))"
    sized = bind(f"named_struct('steps', steps, 'width', {width})", "all", walk)
    return bind(_steps(redacted, placeholder), "steps", f"if(size(steps) > 0, {sized}, {NO_SPANS})")


def align_redaction(
    df: DataFrame,
    original_col: str,
    redacted_col: str,
    placeholder: str = PLACEHOLDER,
    output_col: str = "pii_entities",
) -> DataFrame:
    """Append the spans recovered from an original and a masked text column."""
    return df.withColumn(output_col, F.expr(align_spans(name(original_col), name(redacted_col), placeholder)))

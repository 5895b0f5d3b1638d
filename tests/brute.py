"""Plain-Python counterparts of the row operators, written from their definitions."""

import re

import regex


def align(original, redacted, name="[A-Z]+"):
    parts = re.split(rf"\[({name})\]", redacted)
    plain, labels = parts[0::2], parts[1::2]
    spans, at = [], 0
    for k, label in enumerate(labels):
        start = at + len(plain[k])
        follower = (plain[k + 1] or ("[" if k + 1 < len(labels) else ""))[:1]
        hit = original.find(follower, start) if follower else -1
        at = len(original) if hit < 0 else hit
        spans.append((label, original[start:at], start, at))
    return spans


def locate(text, value):
    for form in (value, value.replace(" ", "")):
        if form == "" and value != "":
            return 0 if text else None
        if form in text:
            return text.index(form)
    return None


def recover(text, entities):
    by_place = {}
    for label, value in entities:
        start = locate(text, value)
        if start is not None:
            by_place.setdefault((start, start + len(value)), (label, value))
    return [(label, value, s, e) for (s, e), (label, value) in by_place.items()]


def detect(text, rules):
    """Leftmost match, first rule on a tie, repeated; no guards and no gates."""
    compiled = [(r.label, regex.compile(f"({r.cue})({r.pattern})")) for r in rules]
    spans, masked, at = [], [], 0
    pending = [p.search(text) for _, p in compiled]
    while True:
        for k, (_, p) in enumerate(compiled):
            anew = "\\G" in p.pattern and at
            if anew or pending[k] is not None and pending[k].start() < at:
                pending[k] = p.search(text, at)
        live = [(m.start(), k) for k, m in enumerate(pending) if m is not None]
        if not live:
            break
        _, k = min(live)
        m, label = pending[k], compiled[k][0]
        spans.append((label, m.group(2), m.start(2), m.end(2)))
        masked += [text[at:m.start(2)], f"[{label}]"]
        at = m.end()
    return "".join([*masked, text[at:]]), spans


def score(pred, gold, ignore_labels):
    key = (lambda s: (s[2], s[3])) if ignore_labels else (lambda s: (s[2], s[3], s[0]))
    p, g = {key(s) for s in pred}, {key(s) for s in gold}
    labels = {}
    for s in pred:
        labels.setdefault(s[0], [0, 0, 0])[0 if key(s) in g else 1] += 1
    for s in gold:
        if key(s) not in p:
            labels.setdefault(s[0], [0, 0, 0])[2] += 1
    return (len(p & g), len(p - g), len(g - p)), {k: tuple(v) for k, v in labels.items()}


def tuples(spans):
    return [(s["label"], s["value"], s["start"], s["end"]) for s in spans]

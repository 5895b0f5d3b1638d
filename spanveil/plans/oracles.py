"""SQL that computes the registered queries another way, for checks in DuckDB.

Matches come from splitting a text at the whole pattern and extracting its
matches; the label of a match is the first rule that matches all of it; offsets
are sums of lengths; masked text is rebuilt from the spans and the original.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from spanveil.functions.text import WHITESPACE
from spanveil.operators.lookup import WORD_CLASS
from spanveil.plans.queries import HEAD, HEAD_TRAIN, HEAD_VALIDATION, ORDER_PARTS, ROWS_PER_FILE, SCORE_DIGITS, TYPE_SUBSET

CARD = "[0-9]{16,}"
WORD = f"[{WORD_CLASS}]+"

# Fixed values, written apart from the operators that they check.
CHAT_PROMPT = """<|system|>
You redact PII from input and return redacted version only. Only use the following PII types: {types}. 
<|user|>
{text}
<|assistant|>
"""
TRAINING_PREFIX = """<|system|>
You are a data redaction assistant. You redact PII in the input below and return only the redacted text. Do not explain anything.
<|user|>
{source}
<|assistant|>
"""
JSON_PROMPT = '''
        You are a data redaction assistant.

        Your task is to identify all Personally Identifiable Information (PII) in the following text and redact them.

        Redact each PII by replacing it with [label] (in uppercase, in square brackets).
        Only use the following PII types: {types}

        For each PII entity found, return:
        - "label": the PII type (from the list above)
        - "value": the original text span
        - "start": the character index where the PII starts in the original text
        - "end": the character index where the PII ends (exclusive)
        Example:
        
Example:
Input: "John Smith's phone number is (555) 123-4567 and his email is john.smith@example.com."
Output:
{
"redacted_text": "[NAME]'s phone number is [PHONE] and his email is [EMAIL].",
"pii_entities": [
    {
    "label": "NAME",
    "value": "John Smith",
    "start": 0,
    "end": 10
    },
    {
    "label": "PHONE",
    "value": "(555) 123-4567",
    "start": 30,
    "end": 45
    },
    {
    "label": "EMAIL",
    "value": "john.smith@example.com",
    "start": 63,
    "end": 86
    }
]
}

        Respond in **valid JSON**. Do not include any other explanation.
        Input:
         """{text}"""
         Output:
        '''
MAX_LENGTH = 512
IGNORED = -100
EPSILON = 1e-9


@dataclass(frozen=True)
class Pattern:
    """What a rule has to find, in RE2, written apart from the rules."""

    label: str
    pattern: str
    cue: str = ""

    @property
    def whole(self) -> str:
        return f"(?:{self.cue})(?:{self.pattern})" if self.cue else f"(?:{self.pattern})"


_MONTHS = (
    "(?:January|February|March|April|May|June|July|August|September|October|November|December|"
    "Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec)"
)
_DAY = (
    r"[0-9]+[-/.][0-9]{1,2}[-/.][0-9]{2,}|[0-9]{4,}[-/][0-9]{1,2}[-/][0-9]+"
    f"|[0-9]+(?:st|nd|rd|th)? {_MONTHS},? [0-9]{{4,}}|{_MONTHS} [0-9]+(?:st|nd|rd|th)?(?:,? [0-9]{{4,}})?"
)
_IS = " {0,3}[:=#] {0,3}"
_NUMBERED = r"[\p{L}\p{M}-]*\p{N}[\p{L}\p{M}\p{N}-]*|[A-Z][A-Z-]{4,}[\p{L}\p{M}\p{N}-]*"
DEFAULT_RULES = (
    Pattern("EMAIL", r"[\p{L}\p{M}\p{N}._%+-]+@[\p{L}\p{M}\p{N}.-]+\.[\p{L}\p{M}]{2,}[\p{L}\p{M}\p{N}-]*"),
    Pattern("GEOCOORD", r"[-+]?[0-9]+\.[0-9]{3,}, ?[-+]?[0-9]+\.[0-9]{3,}"),
    Pattern("IP", r"[0-9]+(?:\.[0-9]+){3,}"),
    Pattern("TEL", r"(?:\+[0-9]{1,3}[ .-])?[0-9]{3,}[ .-][0-9]{3}[ .-][0-9]{4,}|\+[0-9]{4,}[ .-][0-9]{3}[ .-][0-9]{4,}"
            r"|(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4,}"),
    Pattern("SOCIALNUMBER", "[0-9]{3,}-[0-9]{2}-[0-9]{4,}"),
    Pattern("DATE", _DAY),
    Pattern("TIME", "[0-9]+:[0-9]{2,}(?::[0-9]+)*(?: ?[AaPp][Mm])?"),
    Pattern("TITLE", r"(?:Mrs|Mr|Ms|Dr|Prof)\."),
    Pattern("DOB", _DAY, f"(?i:date of birth|birth date|dob|born){_IS}"),
    Pattern("PASS", r"[^\x09-\x0D\x20\x{85}\p{Z}]{3,}[^\x09-\x0D\x20\x{85}\p{Z},;\"']", f"(?i:password|passcode|passwd|pwd|secret|token|api[_-]?key){_IS}[\"']?"),
    Pattern("PASSPORT", _NUMBERED, rf"(?i:passport)(?i: number| no\.?)?{_IS}"),
    Pattern("IDCARD", _NUMBERED, f"(?i:identity card|id card|national id){_IS}"),
    Pattern("DRIVERLICENSE", _NUMBERED, f"(?i:driver'?s? licen[cs]e|driving licen[cs]e){_IS}"),
    Pattern("USERNAME", r"[\p{L}\p{N}][\p{L}\p{M}\p{N}._@+-]+", f"(?i:user ?name|user|login|handle){_IS}"),
    Pattern("POSTCODE", r"[\p{L}\p{M}\p{N}]{3,}(?:-[\p{L}\p{M}\p{N}-]+| [A-Za-z0-9]{3,4}\b)?", f"(?i:zip code|zip|post ?code|postal code){_IS}"),
    Pattern("SEX", r"(?i:female|male|non-binary|diverse)\b", f"(?i:sex|gender){_IS}"),
)
CUSTOM_RULES = (Pattern("CREDITCARD", "[0-9]{16,}"), Pattern("HEXKEY", "[0-9a-f]{40,}"), *DEFAULT_RULES)
# Fixed value: the default labels as a prompt names them.
DEFAULT_TYPES = (
    "TIME, USERNAME, IDCARD, SOCIALNUMBER, EMAIL, PASSPORT, DRIVERLICENSE, DOB, LASTNAME1, IP, GIVENNAME1, SEX, TEL, "
    "CITY, POSTCODE, STREET, STATE, BUILDING, TITLE, COUNTRY, DATE, PASS, SECADDRESS, LASTNAME2, GIVENNAME2, GEOCOORD, LASTNAME3"
)


def select_rules(types: Iterable[str]) -> tuple[Pattern, ...]:
    return tuple(r for r in DEFAULT_RULES if r.label in types)


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def with_(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


def spans_of(rules, table="documents", id_col="doc_id", text_col="text", name="spans") -> str:
    """CTEs up to ``name(id, k, label, value, start, end)`` with 1-based k per text."""
    whole = text("|".join(r.whole for r in rules))
    label = "CASE " + " ".join(
        f"WHEN regexp_full_match(h, {text(r.whole)}) THEN {i}" for i, r in enumerate(rules)
    ) + " END"
    names = "[" + ", ".join(text(r.label) for r in rules) + "]"
    cue = "CASE r " + " ".join(
        f"WHEN {i} THEN length(regexp_extract(h, {text(f'^({r.cue})(?:{r.pattern})$')}, 1))"
        for i, r in enumerate(rules)
        if r.cue
    ) + " ELSE 0 END" if any(r.cue for r in rules) else "0"
    return f"""{name}_cut AS (
  SELECT {id_col} AS id, regexp_split_to_array({text_col}, {whole}) AS lit, regexp_extract_all({text_col}, {whole}) AS hit
  FROM {table}),
{name}_hit AS (
  SELECT id, k, hit[k] AS h, list_sum([length(x) for x in lit[1:k]])
         + coalesce(list_sum([length(x) for x in hit[1:k - 1]]), 0) AS ofs
  FROM {name}_cut, unnest(range(1, len(hit) + 1)) t(k)),
{name}_rule AS (SELECT *, {label} AS r FROM {name}_hit),
{name}_cue AS (SELECT *, {cue} AS c FROM {name}_rule),
{name} AS (
  SELECT id, k, {names}[r + 1] AS label, substring(h, c + 1) AS value,
         CAST(ofs + c AS INTEGER) AS "start", CAST(ofs + length(h) AS INTEGER) AS "end"
  FROM {name}_cue)"""


def masked_from(spans: str, table="documents", id_col="doc_id", text_col="text", name="masked") -> str:
    """CTEs up to ``name(id, original, redacted_text, n_entities)``."""
    return f"""{name}_gap AS (
  SELECT id, label, "start", "end", coalesce(lag("end") OVER (PARTITION BY id ORDER BY "start"), 0) AS before
  FROM {spans}),
{name}_head AS (
  SELECT g.id, string_agg(substring(t.{text_col}, before + 1, "start" - before) || '[' || label || ']', '' ORDER BY "start") AS head,
         max("end") AS last, count(*) AS n
  FROM {name}_gap g JOIN {table} t ON t.{id_col} = g.id GROUP BY g.id),
{name} AS (
  SELECT t.{id_col} AS id, t.{text_col} AS original,
         coalesce(head, '') || substring(t.{text_col}, coalesce(last, 0) + 1) AS redacted_text,
         coalesce(n, 0) AS n_entities
  FROM {table} t LEFT JOIN {name}_head h ON h.id = t.{id_col})"""


def masked_query(rules, table="documents", id_col="doc_id", text_col="text") -> str:
    return with_(
        spans_of(rules, table, id_col, text_col),
        masked_from("spans", table, id_col, text_col),
        select=f"SELECT id AS {id_col}, redacted_text, n_entities FROM masked",
    )


def long_query(rules, id_col="doc_id") -> str:
    return with_(
        spans_of(rules),
        select=f'SELECT {"id AS doc_id" if id_col == "doc_id" else "CAST(id AS VARCHAR) AS id"}, CAST(k - 1 AS INTEGER) AS pos, label, value, "start", "end" FROM spans',
    )


def aligned_from(pairs: str, name="aligned") -> str:
    """CTEs up to ``name(id, k, label, value, start, end)`` for ``pairs(id, o, r)``."""
    return rf"""{name}_p AS (
  SELECT id, o, regexp_split_to_array(r, '\[[A-Z]+\]') AS l, regexp_extract_all(r, '\[([A-Z]+)\]', 1) AS b FROM {pairs}),
{name}_n AS (
  SELECT id, o, b[k] AS label, k, length(l[k]) AS w,
         CASE WHEN l[k + 1] <> '' THEN substring(l[k + 1], 1, 1) WHEN k < len(b) THEN '[' ELSE '' END AS nx
  FROM {name}_p, unnest(range(1, len(b) + 1)) t(k)),
{name}_w AS (
  SELECT DISTINCT id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS i, CAST('' AS VARCHAR) AS label,
         CAST('' AS VARCHAR) AS v, CAST(0 AS BIGINT) AS st FROM {name}_n
  UNION ALL
  SELECT id, k, en, label, CASE WHEN en > st THEN substring(o, st + 1, en - st) ELSE '' END, st FROM (
    SELECT n.id, n.k, n.label, n.o, w.i + n.w AS st,
           CASE WHEN n.nx = '' OR strpos(substring(n.o, w.i + n.w + 1), n.nx) = 0 THEN length(n.o)
                ELSE w.i + n.w + strpos(substring(n.o, w.i + n.w + 1), n.nx) - 1 END AS en
    FROM {name}_w w JOIN {name}_n n ON n.id = w.id AND n.k = w.k + 1)),
{name} AS (
  SELECT id, k, label, v AS value, CAST(st AS INTEGER) AS "start", CAST(i AS INTEGER) AS "end" FROM {name}_w WHERE k > 0)"""


GOLD = (
    spans_of(DEFAULT_RULES),
    masked_from("spans"),
    "pairs AS (SELECT id, original AS o, redacted_text AS r FROM masked)",
)
SCORED = (
    *GOLD,
    aligned_from("pairs"),
    """pred AS (
  SELECT id, label, "start", "end" FROM aligned
  UNION ALL SELECT id, label, "start", "end" FROM aligned WHERE label <> 'EMAIL'
  UNION ALL SELECT id, 'TEL', "start", "end" FROM aligned WHERE label = 'IP')""",
    'gold AS (SELECT id, label, "start", "end" FROM spans)',
)


def ratios(digits: int | None = None) -> str:
    p = f"tp / (tp + fp + {EPSILON})"
    r = f"tp / (tp + fn + {EPSILON})"
    f1 = f"2 * ({p}) * ({r}) / (({p}) + ({r}) + {EPSILON})"
    d = SCORE_DIGITS if digits is None else digits
    return ", ".join(f"round({e}, {d}) AS {n}" for e, n in ((p, "precision"), (r, "recall"), (f1, "f1")))


def counts_per_doc(ignore: bool) -> str:
    key = 'id, "start", "end"' + ("" if ignore else ", label")
    return f"""key_sides AS (
  SELECT {key}, max(p) AS p, max(g) AS g FROM (
    SELECT {key}, 1 AS p, 0 AS g FROM pred UNION ALL SELECT {key}, 0, 1 FROM gold) GROUP BY {key}),
per_doc AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id, count(*) FILTER (p = 1 AND g = 1) AS tp,
         count(*) FILTER (p = 1 AND g = 0) AS fp, count(*) FILTER (p = 0 AND g = 1) AS fn
  FROM documents d LEFT JOIN key_sides s ON s.id = d.doc_id GROUP BY d.doc_id)"""


def overall(ignore: bool, select: str) -> str:
    return with_(
        *SCORED,
        counts_per_doc(ignore),
        "total AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM per_doc)",
        select=select,
    )


def label_totals(ignore: bool) -> str:
    """CTEs up to ``label_total(label, tp, fp, fn)``."""
    same = 'a.id = b.id AND a."start" = b."start" AND a."end" = b."end"' + ("" if ignore else " AND a.label = b.label")
    return f"""marks AS (
  SELECT label, CASE WHEN hit THEN 1 ELSE 0 END AS tp, CASE WHEN hit THEN 0 ELSE 1 END AS fp, 0 AS fn
  FROM (SELECT label, EXISTS (SELECT 1 FROM gold b WHERE {same}) AS hit FROM pred a)
  UNION ALL
  SELECT label, 0, 0, 1 FROM gold a WHERE NOT EXISTS (SELECT 1 FROM pred b WHERE {same})),
label_total AS (
  SELECT label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn
  FROM marks GROUP BY label)"""


def per_label(ignore: bool) -> str:
    return with_(*SCORED, label_totals(ignore), select=f"SELECT label, tp, fp, fn, {ratios()} FROM label_total")


# Values to locate: as found, with a space after two characters, reversed.
GIVEN = (
    spans_of(DEFAULT_RULES),
    """given AS (
  SELECT id, 3 * (k - 1) AS pos, label, value FROM spans
  UNION ALL
  SELECT id, 3 * (k - 1) + 1, label, substring(value, 1, 2) || ' ' || substring(value, 3) FROM spans
  UNION ALL
  SELECT id, 3 * (k - 1) + 2, 'TITLE', reverse(value) FROM spans),
located AS (
  SELECT g.*, CASE WHEN strpos(text, value) > 0 THEN strpos(text, value)
                   ELSE strpos(text, replace(value, ' ', '')) END - 1 AS st
  FROM given g JOIN documents d ON d.doc_id = g.id)""",
)


def first_places(source: str, name="recovered") -> str:
    """First entity per place; ``source(id, pos, label, value, st)`` in list order."""
    return f"""{name}_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id, st, length(value) ORDER BY pos) AS nth FROM {source} WHERE st >= 0),
{name} AS (
  SELECT id, label, value, CAST(st AS INTEGER) AS "start", CAST(st + length(value) AS INTEGER) AS "end",
         CAST(row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS INTEGER) AS pos
  FROM {name}_ranked WHERE nth = 1)"""


CARDS = f"""cards AS (
  SELECT doc_id AS id, text, regexp_replace(text, '{CARD}', '[CARD]', 'g') AS masked,
         regexp_extract_all(text, '{CARD}') AS vs FROM documents),
card_values AS (
  SELECT id, k AS pos, 'CARD' AS label, vs[k] AS value, strpos(text, vs[k]) - 1 AS st
  FROM cards, unnest(range(1, len(vs) + 1)) t(k))"""

# Usable answers are those of the languages whose JSON is whole.
ANSWERED = (
    spans_of(DEFAULT_RULES),
    masked_from("spans"),
    """answered AS (
  SELECT m.id, m.original, m.redacted_text, m.n_entities, d.lang, d.lang NOT IN ('fr', 'de') AND d.doc_id % 7 NOT IN (1, 2, 3) AS usable
  FROM masked m JOIN documents d ON d.doc_id = m.id),
answer_values AS (
  SELECT s.id, s.k AS pos, s.label, s.value, strpos(a.original, s.value) - 1 AS st
  FROM spans s JOIN answered a ON a.id = s.id WHERE a.usable)""",
    first_places("answer_values"),
)

LISTED = (
    spans_of(DEFAULT_RULES),
    f"""names AS (
  SELECT DISTINCT lower(w) AS term, CASE WHEN length(w) >= 9 THEN 'LASTNAME1' ELSE 'GIVENNAME1' END AS label
  FROM (SELECT unnest(regexp_extract_all(text, '{WORD}')) AS w FROM benchmark)
  WHERE regexp_full_match(w, '[A-Z][a-z]{{5,}}')),
plain AS (
  SELECT id, before AS ofs, substring(text, before + 1, "start" - before) AS piece FROM (
    SELECT s.id, d.text, s."start", coalesce(lag(s."end") OVER (PARTITION BY s.id ORDER BY s."start"), 0) AS before
    FROM spans s JOIN documents d ON d.doc_id = s.id)
  UNION ALL
  SELECT d.doc_id, coalesce(max(s."end"), 0), substring(d.text, coalesce(max(s."end"), 0) + 1)
  FROM documents d LEFT JOIN spans s ON s.id = d.doc_id GROUP BY d.doc_id, d.text),
chopped AS (
  SELECT id, ofs, regexp_split_to_array(piece, '{WORD}') AS gaps, regexp_extract_all(piece, '{WORD}') AS words FROM plain),
word_rows AS (
  SELECT id, ofs, j, gaps[j] AS gap, words[j] AS word FROM chopped, unnest(range(1, len(words) + 1)) t(j)),
placed AS (
  SELECT id, word, ofs + sum(length(gap) + length(word)) OVER (PARTITION BY id, ofs ORDER BY j) AS stop FROM word_rows),
listed AS (
  SELECT id, label, value, "start", "end" FROM spans
  UNION ALL
  SELECT id, n.label, word, CAST(stop - length(word) AS INTEGER), CAST(stop AS INTEGER)
  FROM placed JOIN names n ON n.term = lower(word))""",
)
NAMES = LISTED[1][: LISTED[1].index("plain AS (")].rstrip().rstrip(",")
# Names of documents as well as of items.
WIDELY_LISTED = (
    LISTED[0],
    LISTED[1].replace("FROM benchmark)", "FROM (SELECT text FROM benchmark UNION ALL SELECT text FROM documents))"),
    *LISTED[2:],
)
LISTED_LONG = with_(
    *LISTED,
    select="""SELECT id AS doc_id, CAST(row_number() OVER (PARTITION BY id ORDER BY "start") - 1 AS INTEGER) AS pos,
       label, value, "start", "end" FROM listed""",
)

PHRASES = (
    *LISTED[:1],
    f"""firsts AS (
  SELECT DISTINCT lower(ws[1]) AS a, lower(ws[2]) AS b
  FROM (SELECT regexp_extract_all(text, '{WORD}') AS ws FROM benchmark) WHERE len(ws) >= 2),
phrases AS (SELECT a, b FROM firsts WHERE b NOT IN (SELECT a FROM firsts))""",
    LISTED[1][LISTED[1].index("plain AS (") : LISTED[1].index("placed AS (")].rstrip().rstrip(","),
    """placed AS (
  SELECT id, word, ofs + sum(length(gap) + length(word)) OVER w AS stop, lead(gap) OVER w AS gap_after,
         lead(word) OVER w AS word_after
  FROM word_rows WINDOW w AS (PARTITION BY id, ofs ORDER BY j)),
listed AS (
  SELECT id, label, value, "start", "end" FROM spans
  UNION ALL
  SELECT id, 'LASTNAME2', word || gap_after || word_after, CAST(stop - length(word) AS INTEGER),
         CAST(stop + length(gap_after) + length(word_after) AS INTEGER)
  FROM placed JOIN phrases ON a = lower(word) AND b = lower(word_after)
  WHERE regexp_full_match(gap_after, '\\s+'))""",
)

# Offsets from the parts' own lengths.
_TEXTS = ", ".join(f"{text(before)} AS b{i}, CAST({value} AS VARCHAR) AS v{i}" for i, (before, value, _) in enumerate(ORDER_PARTS))
_BEFORE = [" + ".join(f"length(b{j}) + length(v{j})" for j in range(i)) or "0" for i in range(len(ORDER_PARTS))]
TABLE_TEXT = f"WITH t AS (SELECT o_orderkey, {_TEXTS} FROM orders)\n" + "\nUNION ALL\n".join(
    f"""SELECT o_orderkey, {i} AS pos, '{label}' AS label, v{i} AS value, CAST({_BEFORE[i]} + length(b{i}) AS INTEGER) AS "start",
  CAST({_BEFORE[i]} + length(b{i}) + length(v{i}) AS INTEGER) AS "end" FROM t"""
    for i, (_, _, label) in enumerate(ORDER_PARTS)
)

CORPUS = """corpus AS (
  SELECT CAST(m.id AS VARCHAR) AS id, d.lang AS language,
         CASE WHEN m.id % 10 = 0 THEN 'validation' ELSE 'train' END AS "set",
         m.original AS source_text, m.redacted_text AS target_text, m.n_entities, m.id AS n
  FROM masked m JOIN documents d ON d.doc_id = m.id)"""
SPLITS = """splits AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, lang AS language, text AS source_text,
         CASE WHEN doc_id % 10 = 0 THEN 'validation' ELSE 'train' END AS "set" FROM documents)"""


def filled(template: str, column: str, types: str = DEFAULT_TYPES) -> str:
    before, after = template.replace("{types}", types).replace("{source}", "{text}").split("{text}")
    return f"{text(before)} || {column} || {text(after)}"




def merged_from(names: str, order: tuple[str, ...], table="documents", id_col="doc_id") -> tuple[str, ...]:
    """CTEs up to ``merged(id, label, value, start, end)``: each character goes to its best span; ``names(term, label)``."""
    numbers = {name: i for i, name in enumerate(order)}
    return (
        spans_of(DEFAULT_RULES, table, id_col),
        names,
        CARDS.replace("doc_id AS id", f"{id_col} AS id").replace("FROM documents", f"FROM {table}"),
        first_places("card_values"),
        f"""word_lists AS (
  SELECT {id_col} AS id, regexp_split_to_array(text, '{WORD}') AS gaps, regexp_extract_all(text, '{WORD}') AS words FROM {table}),
word_places AS (
  SELECT id, words[j] AS word, sum(length(gaps[j]) + length(words[j])) OVER (PARTITION BY id ORDER BY j) AS stop
  FROM word_lists, unnest(range(1, len(words) + 1)) t(j)),
candidates AS (
  SELECT id, {numbers['rules']} AS d, label, "start", "end" FROM spans
  UNION SELECT id, {numbers['model']}, label, "start", "end" FROM recovered
  UNION SELECT id, {numbers['lists']}, n.label, stop - length(word), stop FROM word_places JOIN names n ON n.term = lower(word)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, "start" - "end", "start", label) AS best FROM candidates),
characters AS (
  SELECT id, c, min(best) AS best FROM (SELECT id, best, unnest(range("start", "end")) AS c FROM numbered) GROUP BY id, c),
stretches AS (
  SELECT id, best, CAST(min(c) AS INTEGER) AS "start", CAST(max(c) + 1 AS INTEGER) AS "end"
  FROM (SELECT *, c - row_number() OVER (PARTITION BY id, best ORDER BY c) AS island FROM characters) GROUP BY id, best, island),
merged AS (
  SELECT id, label, value, s."start", s."end" FROM (
    SELECT s.*, n.label, n."end" - n."start" AS size, substring(t.text, s."start" + 1, s."end" - s."start") AS value
    FROM stretches s JOIN numbered n USING (id, best) JOIN {table} t ON t.{id_col} = s.id) s
  WHERE s."end" - s."start" = size OR regexp_matches(value, '[\\p{{L}}\\p{{N}}]'))""",
    )


TOKENS = (
    *GOLD[:2],
    CORPUS,
    f"""worded AS (
  SELECT id, [w for w in regexp_split_to_array({filled(TRAINING_PREFIX, 'source_text')} || target_text, '[ \\t\\r\\n]+') if w <> ''] AS ws,
         [w for w in regexp_split_to_array({filled(TRAINING_PREFIX, 'source_text')}, '[ \\t\\r\\n]+') if w <> ''] AS ps FROM corpus),
coded AS (
  SELECT id, [('0x' || substr(md5(w), 1, 7))::INTEGER + 1 for w in ws[1:{MAX_LENGTH}]] AS ids,
         least(len(ps), {MAX_LENGTH}) AS prefix FROM worded)""",
)
_PAD = f"CASE WHEN len(ids) < {MAX_LENGTH} THEN repeat(' {{}}', {MAX_LENGTH} - len(ids)) ELSE '' END"
_STRIP = text(WHITESPACE)



def files(rows: int) -> str:
    """Texts of a language and a range of ids as one file each."""
    return f"""files AS (
  SELECT lang, CAST(floor(doc_id / {rows}) AS BIGINT) AS part, lang || '/' || CAST(floor(doc_id / {rows}) AS BIGINT) AS file,
         string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS text
  FROM documents WHERE text IS NOT NULL GROUP BY ALL)"""


FILE_PHRASES = tuple(
    part.replace("d.doc_id", "d.file").replace("FROM documents", "FROM files").replace("JOIN documents", "JOIN files")
    for part in (spans_of(DEFAULT_RULES, "files", "file"), *PHRASES[1:])
)

ORACLES: dict[str, str] = {
    "redact_documents": masked_query(DEFAULT_RULES),
    "stream_redact": masked_query(DEFAULT_RULES),
    "stream_redact_dictionary": with_(
        *LISTED,
        masked_from("listed"),
        select="SELECT id AS doc_id, redacted_text, n_entities FROM masked",
    ),
    "stream_redact_stub": with_(
        CARDS, select="SELECT id AS doc_id, masked AS redacted_text, false AS failed FROM cards"
    ),
    "dictionary_phrases": with_(
        *PHRASES,
        select="""SELECT id AS doc_id, CAST(row_number() OVER (PARTITION BY id ORDER BY "start") - 1 AS INTEGER) AS pos,
       label, value, "start", "end" FROM listed""",
    ),
    "redact_table_text": TABLE_TEXT,
    "redact_corpus_job": long_query(CUSTOM_RULES, "id"),
    "redact_corpus_types_file": long_query(select_rules(("EMAIL", "IP")), "id"),
    "redact_files_job": with_(
        files(ROWS_PER_FILE),
        spans_of(DEFAULT_RULES, "files", "file"),
        masked_from("spans", "files", "file"),
        select="SELECT length(original) AS n_chars, md5(redacted_text) AS masked_md5, n_entities FROM masked",
    ),
    "redact_large_files_job": with_(
        files(20 * ROWS_PER_FILE),
        *FILE_PHRASES,
        select='SELECT lang, part, label, value, CAST("start" AS BIGINT) AS "start", CAST("end" AS BIGINT) AS "end" FROM listed JOIN files ON file = id',
    ),
    "score_results_job": with_(
        spans_of(DEFAULT_RULES),
        spans_of(CUSTOM_RULES, name="own"),
        'gold AS (SELECT id, label, "start", "end" FROM spans)',
        'pred AS (SELECT id, label, "start", "end" FROM own)',
        counts_per_doc(False),
        "total AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM per_doc)",
        select=f"SELECT tp, fp, fn, {ratios()} FROM total",
    ),
    "entities_long": long_query(DEFAULT_RULES),
    "redact_conversations": with_(
        "turns AS (SELECT conv_id, turn, text, row_number() OVER () AS rid FROM conversations)",
        spans_of(DEFAULT_RULES, "turns", "rid"),
        masked_from("spans", "turns", "rid"),
        select="""SELECT t.conv_id, t.turn, m.redacted_text, m.n_entities FROM masked m JOIN turns t ON t.rid = m.id""",
    ),
    "redact_pages": masked_query(DEFAULT_RULES, "pages", "page_id", "html"),
    "redact_type_subset": masked_query(select_rules(TYPE_SUBSET)),
    "redact_custom_types": long_query(CUSTOM_RULES),
    "redact_head_n": with_(
        f"head AS (SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT {HEAD})",
        spans_of(DEFAULT_RULES, "head"),
        masked_from("spans", "head"),
        select="SELECT id AS doc_id, redacted_text, n_entities FROM masked",
    ),
    "redact_dictionary": with_(
        *LISTED,
        masked_from("listed"),
        select="SELECT id AS doc_id, redacted_text, n_entities FROM masked",
    ),
    "dictionary_entities": LISTED_LONG,
    "dictionary_broadcast_join": LISTED_LONG,
    "dictionary_shuffle_join": LISTED_LONG,
    "dictionary_positions": with_(
        *WIDELY_LISTED,
        masked_from("listed"),
        select="SELECT id AS doc_id, redacted_text, n_entities FROM masked",
    ),
    "stream_redact_long_list": with_(
        *LISTED,
        masked_from("listed"),
        select="SELECT id AS doc_id, redacted_text, n_entities FROM masked",
    ),
    "redact_with_stub": with_(
        CARDS,
        first_places("card_values"),
        select='SELECT id AS doc_id, pos, label, value, "start", "end" FROM recovered',
    ),
    "redact_with_stub_text": with_(
        CARDS, select="SELECT id AS doc_id, masked AS redacted_text, false AS failed FROM cards"
    ),
    "merged_redaction": with_(
        *merged_from(NAMES, ("lists", "rules", "model")),
        select="""SELECT id AS doc_id, CAST(row_number() OVER (PARTITION BY id ORDER BY "start") - 1 AS INTEGER) AS pos,
       label, value, "start", "end" FROM merged""",
    ),
    "merged_table_text": with_(
        """texts AS (
  SELECT o_orderkey, 'to maker @ex; card ' || lpad(CAST(o_orderkey AS VARCHAR), 16, '4') || '@mail.com; user: maker'
    || o_custkey || '-1234567890123456.' AS text FROM orders)""",
        *merged_from(
            "names AS (SELECT * FROM (VALUES ('maker', 'LASTNAME1'), ('mail', 'CITY'), ('com', 'STATE')) n(term, label))",
            ("model", "rules", "lists"),
            "texts",
            "o_orderkey",
        ),
        masked_from("merged", "texts", "o_orderkey", name="done"),
        select="SELECT id AS o_orderkey, redacted_text, n_entities FROM done",
    ),
    "durable_answers": with_(
        CARDS,
        select="""SELECT id AS doc_id, masked AS redacted_text, text IS NULL AS failed, CASE WHEN text IS NULL THEN 'no text' END AS failure
FROM cards""",
    ),
    "redact_with_chat_stub": with_(
        CARDS,
        f"pairs AS (SELECT id, text AS o, trim(masked, {_STRIP}) AS r FROM cards)",
        aligned_from("pairs"),
        select='SELECT id AS doc_id, CAST(k - 1 AS INTEGER) AS pos, label, value, "start", "end" FROM aligned',
    ),
    "redact_fallback": with_(
        *ANSWERED,
        select="""SELECT a.id AS doc_id, NOT usable AS failed,
       CASE WHEN usable THEN redacted_text ELSE original END AS redacted_text,
       (SELECT count(*) FROM recovered r WHERE r.id = a.id) AS n_entities FROM answered a""",
    ),
    "parse_model_json": with_(
        *ANSWERED,
        select="""SELECT id AS doc_id, usable, CASE WHEN usable THEN redacted_text END AS redacted_text,
       CASE WHEN usable THEN n_entities END AS n_entities FROM answered""",
    ),
    "prompt_local": f"SELECT doc_id, {filled(CHAT_PROMPT, 'text')} AS prompt FROM documents",
    "prompt_json": f"SELECT doc_id, {filled(JSON_PROMPT, 'text')} AS prompt FROM documents",
    "extract_response": with_(
        spans_of(DEFAULT_RULES),
        masked_from("spans"),
        select=f"SELECT id AS doc_id, trim(redacted_text, {_STRIP}) AS response FROM masked",
    ),
    "align_redaction": with_(
        *GOLD,
        aligned_from("pairs"),
        select="""SELECT CAST(id AS VARCHAR) AS id, CAST(k - 1 AS INTEGER) AS pos, label, value, "start", "end" FROM aligned""",
    ),
    "recover_spans": with_(
        *GIVEN,
        first_places("located"),
        select='SELECT id AS doc_id, pos, label, value, "start", "end" FROM recovered',
    ),
    "approx_span": with_(
        *GIVEN,
        select="""SELECT id AS doc_id, CAST(pos AS INTEGER) AS pos, value,
       CAST(strpos(text, replace(value, ' ', '')) - 1 AS INTEGER) AS "start"
       FROM given JOIN documents ON doc_id = id""",
    ),
    "unlocated_values": with_(
        *GIVEN, select="SELECT id AS doc_id, CAST(pos AS INTEGER) AS pos, label, value FROM located WHERE st < 0"
    ),
    "score_per_doc": with_(*SCORED, counts_per_doc(False), select="SELECT id, tp, fp, fn FROM per_doc"),
    "score_per_doc_ignore_labels": with_(
        *SCORED, counts_per_doc(True), select="SELECT id, tp, fp, fn FROM per_doc"
    ),
    "score_overall": overall(False, f"SELECT tp, fp, fn, {ratios()} FROM total"),
    "score_overall_ignore_labels": overall(True, f"SELECT tp, fp, fn, {ratios()} FROM total"),
    "score_both_tables": with_(
        *SCORED,
        counts_per_doc(False),
        "total AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM per_doc)",
        label_totals(False),
        select=f"""SELECT label, tp, fp, fn, {ratios()}
FROM (SELECT 'all labels' AS label, tp, fp, fn FROM total UNION ALL SELECT label, tp, fp, fn FROM label_total)""",
    ),
    "score_long_form": overall(False, f"SELECT tp, fp, fn, {ratios()} FROM total"),
    "score_report": overall(False, f"SELECT {ratios(4)} FROM total"),
    "score_per_label": per_label(False),
    "score_per_label_ignore_labels": per_label(True),
    "score_long_per_label": per_label(False),
    "score_long_per_label_ignore_labels": per_label(True),
    "corpus_output": with_(
        *GOLD[:2],
        CORPUS,
        """listing AS (SELECT id, string_agg(label || ':' || "start" || ':' || "end", ' ' ORDER BY k) AS spans,
  string_agg(label, ' ' ORDER BY k) AS labels FROM spans GROUP BY id)""",
        select="""SELECT c.id, language, "set", source_text AS original_source_text, target_text AS original_target_text,
       coalesce(spans, '') AS original_privacy_mask, coalesce(labels, '') AS original_span_labels,
       target_text AS redacted_text, coalesce(spans, '') AS pii_entities, source_text AS mbert_text_tokens,
       'O' AS mbert_bio_labels FROM corpus c LEFT JOIN listing l ON l.id = c.n""",
    ),
    "split_write_read": with_(
        *GOLD[:2], CORPUS, select='SELECT id, "set", source_text, n_entities AS n_gold FROM corpus'
    ),
    "results_json_roundtrip": with_(
        *GOLD[:2],
        select="""SELECT CAST(s.id AS VARCHAR) AS id, m.redacted_text, CAST(k - 1 AS INTEGER) AS pos, label, value, "start", "end"
       FROM spans s JOIN masked m ON m.id = s.id""",
    ),
    "results_json_texts": with_(
        *GOLD[:2],
        select="SELECT CAST(id AS VARCHAR) AS id, original AS original_source_text, redacted_text, n_entities FROM masked",
    ),
    "split_counts": with_(SPLITS, select='SELECT "set", count(*) AS "rows" FROM splits GROUP BY "set"'),
    "split_sample": with_(
        *GOLD[:2],
        CORPUS,
        select="""SELECT id, language, "set", source_text, target_text FROM corpus WHERE "set" = 'train' ORDER BY id LIMIT 1""",
    ),
    "sft_head_per_split": with_(
        SPLITS,
        select=f"""SELECT id, "set", source_text FROM (
  SELECT *, row_number() OVER (PARTITION BY "set" ORDER BY id) AS nth FROM splits)
WHERE nth <= CASE "set" WHEN 'train' THEN {HEAD_TRAIN} ELSE {HEAD_VALIDATION} END""",
    ),
    "sft_examples": with_(
        *GOLD[:2],
        CORPUS,
        select=f"""SELECT id, {filled(TRAINING_PREFIX, 'source_text')} AS prompt,
       {filled(TRAINING_PREFIX, 'source_text')} || target_text AS text FROM corpus""",
    ),
    "sft_tokens": with_(
        *TOKENS,
        select=f"""SELECT id, array_to_string(ids, ' ') || {_PAD.format(0)} AS input_ids,
       trim(repeat('1 ', len(ids)) || repeat('0 ', {MAX_LENGTH} - len(ids))) AS attention_mask FROM coded""",
    ),
    "sft_labels": with_(
        *TOKENS,
        select=f"""SELECT id, array_to_string([CASE WHEN i <= prefix OR i > len(ids) THEN {IGNORED} ELSE ids[i] END
       for i in range(1, {MAX_LENGTH} + 1)], ' ') AS labels FROM coded""",
    ),
}

from itertools import permutations

from plain import words

from spanveil.llm.audit import BITS, filter_audit, mask_cells


def failures(docs):
    """Letters that each row (id, text, part) fails, one by one."""
    out = []
    for key, text, _ in docs:
        text = text or ""
        w = words(text, lower=False)
        fails = ""
        fails += "A" if len(w) < 200 else ""
        fails += "B" if 100 * len(set(w)) < 50 * len(w) else ""
        fails += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text) else ""
        fails += "D" if set(text) & set("#$%&*|") else ""
        older = [k for k, t, _ in docs if k is not None and key is not None and (t or "") == text and k < key]
        fails += "E" if older else ""
        out.append(fails)
    return out


def audit(docs, marks):
    """(part, order, step) -> metrics, by applying each order to all rows."""
    fails = failures(docs)
    out = {}
    for part in {p or "" for _, _, p in docs}:
        rows = [(k, f) for (k, _, p), f in zip(docs, fails) if (p or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if letter in r[1]]
                left = [r for r in left if letter not in r[1]]
                shapley[letter] += len(gone)
                out[part, order, step] = [
                    len(left),
                    len(gone),
                    sum(letter in f for _, f in rows) - len(gone),
                    sum(f == letter for _, f in rows),
                    sum(marks.get(k, (0, 0))[0] == 1 for k, _ in gone),
                    sum(marks.get(k, (0, 0))[1] == 1 for k, _ in gone),
                ]
        for order in map("".join, permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                out[part, order, step].append(shapley[letter])
    return {k: tuple(v) for k, v in out.items()}


def rows_of(df):
    got = [
        ((r.part, r.filter_order, r.step), (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley))
        for r in df.collect()
    ]
    assert len(got) == len(dict(got))
    return dict(got)


LONG = " ".join(f"w{i}" for i in range(230))
# Copies, ties, repeated rows and ids, null ids, parts and texts, a text on each side of every limit.
DOCS = [
    (1, LONG, "en"), (2, LONG, "en"), (3, LONG, "de"), (3, LONG, "de"), (4, LONG + " #", "en"), (5, LONG + " #", None),
    (6, "word " * 300, "en"), (6, "other text", "en"), (7, "AB" + "c" * 65, "en"), (8, "AB" + "c" * 64, "en"),
    (9, None, "en"), (10, "", "de"), (11, "   \n\t ", "de"), (None, LONG, "en"), (None, None, None), (None, None, None),
    (12, " ".join(f"w{i % 100}" for i in range(200)), "en"), (13, " ".join(f"w{i % 99}" for i in range(199)), "de"),
    (1, LONG, "en"), (14, "ÄÖÜ " * 250, ""), (15, LONG + "\x1c" + LONG, "en"),
]
MARKS = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (6, 1, None), (6, 0, 1), (9, None, 1), (14, 1, 1), (99, 1, 1), (None, 1, 1)]


def tables(spark, docs=DOCS, marks=MARKS):
    d = spark.createDataFrame([(*r, 0, "q") for r in docs], "doc_id long, text string, lang string, n int, quality string")
    return d, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def best(marks):
    out = {}
    for key, q, t in marks:
        if key is not None:
            a, b = out.get(key, (0, 0))
            out[key] = max(a, q or 0), max(b, t or 0)
    return out


def test_equals_rows_filtered_one_by_one(spark):
    assert rows_of(filter_audit(*tables(spark))) == audit(DOCS, best(MARKS))


def test_masks(spark):
    docs, marks = tables(spark)
    got = {}
    for r in mask_cells(docs, marks).collect():
        got[r.part, r.mask] = r.n
    want = {}
    for (_, _, part), fails in zip(DOCS, failures(DOCS)):
        at = part or "", sum(BITS[x] for x in fails)
        want[at] = want.get(at, 0) + 1
    assert got == want


def test_edges_and_empty_tables(spark, edges, nothing):
    _, marks = tables(spark)
    rows = [(r.doc_id, r.text, r.lang) for r in edges.collect()]
    assert rows_of(filter_audit(edges, marks)) == audit(rows, best(MARKS))
    assert rows_of(filter_audit(edges, marks.where("false"))) == audit(rows, {})
    assert rows_of(filter_audit(nothing, marks)) == {}


def test_many_parts_pass_the_recursion_limit(spark):
    """Spark stops a recursion at a million rows; parts must not."""
    docs = spark.range(3500).selectExpr("id AS doc_id", "cast(id AS string) AS lang", "'x' AS text")
    _, marks = tables(spark)
    assert filter_audit(docs, marks).count() == 3500 * 600


def test_hot_copies_stay_small(spark):
    """A text that most rows share counts one passing row, whatever the parts."""
    docs = spark.range(20_000).selectExpr("id AS doc_id", "if(id % 2 = 0, 'en', 'de') AS lang", f"if(id % 10 < 9, '{LONG}', concat('x', id)) AS text")
    _, marks = tables(spark)
    cells = {(r.part, r.mask): r.n for r in mask_cells(docs, marks).collect()}
    assert cells["en", 0] == 1 and ("de", 0) not in cells
    assert cells["en", 16] + cells["de", 16] == 18_000 - 1

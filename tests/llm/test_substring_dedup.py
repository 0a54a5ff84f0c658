import re

from weft.llm.substring_dedup import keep_unique_passages, substring_dedup, units

own = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
LONG = own("Word", 60)
OTHER = own("other", 25)
SHORT = "All rights reserved."
PASSAGE = ". ".join(own(f"p{k}x", 9) for k in range(6)) + "."
VERSE = "\n".join(own(f"v{k}x", 5) for k in range(12))
DATA = [
    (1, f"{SHORT}\n{LONG}\nend"), (2, f"start\n{LONG.upper()}\n{OTHER}\n"), (3, f"  {LONG.replace(' ', '  ')}\t"), (4, f"{OTHER}\n{OTHER}\n{SHORT}"),
    (5, None), (6, ""), (7, f"é {LONG}\n{LONG}"), (8, "x\n" * 5000 + LONG), (9, SHORT), (None, OTHER), (7, f"é {LONG}\n{LONG}"), (10, " \n\t "),
    (11, f"{own('a', 30)}. {PASSAGE} {own('b', 30)}"), (12, f"{own('c', 40)} {PASSAGE.upper()} {own('d', 9)}.\n\n"), (13, f"{own('e', 30)}.\n{PASSAGE.replace('. ', '.' + chr(10))}"),
    (14, f"top\n{VERSE}"), (15, f"{own('f', 9)}\n{VERSE}\nlast"), (16, "One. " * 90), (17, f"{own('g', 9)}! {own('h', 9)}? {own('i', 12)}"), (18, f"{own('h', 9)}? {own('g', 9)}! {own('j', 30)}"),
    (19, f"{own('k', 9)}. {own('k', 9)}. {own('k', 9)}. {own('k', 9)}."), (20, "a.b " * 3 + "\x1c.\x85 " + own("l", 30)), (None, f"{PASSAGE} q"), (21, f"{PASSAGE}\n \n"),
]


def brute(data, unit_words=8, least=20):
    """Segments sign by sign, units one by one, and all occurrences in one table."""
    white = " \t\n\v\f\r"

    def segments(t):
        start = 0
        for k in range(1, len(t) + 1):
            ends = t[k - 1] == "\n"
            if t[k - 1] in white and t[k - 1] != "\n" and (k == len(t) or t[k] not in white or t[k] == "\n"):
                j = k - 1
                while j > start and t[j - 1] in white and t[j - 1] != "\n":
                    j -= 1
                ends = j > 0 and t[j - 1] in ".!?"
            if ends:
                yield start, k
                start = k
        yield start, len(t)

    def cover(t):
        found, held, begin = [], [], 0
        for a, b in segments(t):
            words = re.findall(r"[^\x20\x09-\x0D]+", t[a:b])
            held += words
            if len(words) >= unit_words:
                found.append([begin, b, held])
                held, begin = [], b
        if held:
            found.append([begin, len(t), held])
        elif found:
            found[-1][1] = len(t)
        return [(a, b, re.sub("[A-Z]", lambda m: m.group().lower(), " ".join(w)), len(w)) for a, b, w in found]

    rank = lambda d: (d is None, d or 0)
    first = {}
    for d, t in data:
        for a, _, norm, _ in cover(t or ""):
            first[norm] = min(first.get(norm, (rank(d), a, d)), (rank(d), a, d), key=lambda x: x[:2])
    out = []
    for d, t in data:
        runs = [[]]
        for a, b, norm, n in cover(t or ""):
            if first[norm][:2] == (rank(d), a):
                runs.append([])
            else:
                runs[-1].append((a, b, first[norm], n))
        runs = [r for r in runs if sum(x[3] for x in r) >= least]
        spans = [f"{r[0][0]},{r[-1][1]},{'null' if r[0][2][2] is None else r[0][2][2]},{r[0][2][1]}" for r in runs]
        gone = {k for r in runs for k in range(r[0][0], r[-1][1])}
        out.append((str(d), None if t is None else "".join(c for k, c in enumerate(t) if k not in gone), len(runs), ";".join(spans)))
    return sorted(out, key=str)


def found(rows):
    return sorted(((str(r.doc_id), r.text, r.n_removed, r.removed_spans) for r in rows), key=str)


def test_equals_brute_force(spark):
    docs = spark.createDataFrame([(d, t, 5, b"x") for d, t in DATA], "doc_id long, text string, removed int, digest binary")
    rows = substring_dedup(docs).collect()
    assert found(rows) == brute(DATA)
    text = {r.doc_id: r for r in rows if r.doc_id != 7}
    # A passage that stands mid-line in unlike documents: all of it but the sentence that the line's own words run into.
    assert text[12].n_removed == 1 and "p0x0" in text[12].text.lower() and "p1x0" not in text[12].text.lower()
    assert text[13].text == f"{own('e', 30)}.\n" and text[15].text == f"{own('f', 9)}\n{VERSE}\nlast"
    assert text[16].n_removed == 0 and text[18].n_removed == 0 and text[19].text == f"{own('k', 9)}. "
    assert substring_dedup(docs.limit(0)).count() == 0


def test_shared_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(substring_dedup(docs).collect()) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_verse_without_long_lines_is_one_unit_each():
    assert [n for *_, w in units(VERSE) for n in [len(w)]] == [60]
    assert [len(w) for *_, w in units(f"{VERSE}\n{LONG}")] == [120]


def test_stage_keeps_columns_and_drops_emptied(spark):
    docs = spark.createDataFrame([(d, t, 5) for d, t in DATA], "doc_id long, text string, removed int")
    left = keep_unique_passages(docs)
    assert left.columns == docs.columns
    stay = [d for d, t, n, _ in brute(DATA) if not n or t.strip()]
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(stay) and len(stay) < len(DATA)


def test_hot_passage(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", f"concat('own ', id, '\\n', '{PASSAGE}') as text")
    rows = substring_dedup(docs).collect()
    assert sum(r.n_removed for r in rows) == 2999
    assert all(PASSAGE[80:] not in r.text for r in rows if r.doc_id)


def test_very_long_text(spark):
    line = own("w", 9)
    text = "\n".join(f"{line} {k}" for k in range(40_000))
    rows = substring_dedup(spark.createDataFrame([(1, text), (2, f"top of {text}")], "doc_id long, text string")).collect()
    assert {r.doc_id: len(r.text) for r in rows} == {1: len(text), 2: len(f"top of {line} 0\n")}

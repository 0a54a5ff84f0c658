import hashlib

import pytest
from pyspark.sql import functions as F

from weft.llm.exact_dedup import drop_exact_duplicates, exact_dedup, merge_runs


def test_against_brute_force(spark):
    data = [(k, f"text {k % 37}") for k in range(400)] + [(1000 + k, "hot") for k in range(300)]
    data += [(2000, None), (2001, ""), (2002, "x" * 200_000), (2003, "x" * 200_000), (2004, "hot "), (None, "alone"), (None, "hot"), (5, "text 5")]
    docs = spark.createDataFrame([(i, t, 1, "a") for i, t in data], "doc_id long, text string, kept int, __run string")
    groups = {}
    for i, t in data:
        groups.setdefault(t or "", []).append(i)
    want = []
    for i, t in data:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        want.append((str(i), str(keep), len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    rows = exact_dedup(docs).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in rows) == sorted(want)
    left = drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(w[0] for w in want if w[3])


def test_smallest_may_stay_and_empty(spark):
    docs = spark.createDataFrame([(3, "a"), (2, "a"), (9, "b")], "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in exact_dedup(docs, keep="min").collect()} == {3: 2, 2: 2, 9: 9}
    assert exact_dedup(docs.limit(0)).count() == 0


def test_merge_of_runs(spark):
    """Sorted runs merge over three levels into one entry a digest; the plan has the sorts and no row meets in one task by run alone."""
    entries = [(k % 64, k % 3, bytes([k % 7, 1]), k % 7 + 10, k % 7 * 5, k if k % 11 else None, 1 + k % 2) for k in range(640)]
    df = spark.createDataFrame(entries, "__run int, __range int, __sha binary, __bytes long, __check long, __keep long, __n long")
    # A digest has one range.
    df = df.withColumn("__range", F.hash("__sha") % 5)
    merged = merge_runs(df)
    want = {}
    for *_, sha, size, check, keep, n in entries:
        best, total = want.get(sha, (None, 0))
        want[sha] = (keep if best is None else best if keep is None else max(best, keep), total + n)
    assert {bytes(r["__sha"]): (r["__keep"], r["__n"]) for r in merged.collect()} == want
    assert merged._jdf.queryExecution().executedPlan().toString().count("Window") >= 2


def test_disagreement_raises(spark):
    """Two entries of one digest whose lengths differ are an error, not two groups."""
    df = spark.createDataFrame([(0, 0, b"x", 1, 5, 1, 1), (1, 0, b"x", 2, 5, 2, 1)], "__run int, __range int, __sha binary, __bytes long, __check long, __keep long, __n long")
    with pytest.raises(Exception, match="one SHA-256"):
        merge_runs(df).collect()

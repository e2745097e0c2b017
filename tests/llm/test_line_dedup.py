import random

from grainmill.llm.line_dedup import dedup_lines

SCHEMA = "doc_id long, text string, row_id long, n_lines string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def brute(rows, min_words=5):
    lines = []
    for r, (doc, text) in enumerate(rows):
        for k, line in enumerate((text or "").split("\n")):
            if w := line.lower().split():
                lines.append(((doc is None, doc or 0, r, k), w))
    lines.sort(key=lambda x: x[0])
    gone = set()
    for i, (at, w) in enumerate(lines):
        for _, v in lines[:i]:
            if v == w or (min(len(v), len(w)) >= min_words and abs(len(v) - len(w)) <= 1 and distance(v, w) <= 1):
                gone.add((at[2], at[3]))
                break
    return [None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (r, k) not in gone) for r, (_, t) in enumerate(rows)]


def run(spark, rows):
    df = spark.createDataFrame([(d, t, i, None) for i, (d, t) in enumerate(rows)], SCHEMA).coalesce(1)
    out = dedup_lines(df)
    return [r["text"] for r in sorted(out.collect(), key=lambda r: r["row_id"])]


def test_matches_brute_force(spark):
    rng = random.Random(5)
    base = [[rng.choice("abcdefgh") for _ in range(rng.randint(4, 8))] for _ in range(12)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 4)):
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                k, p = rng.randrange(3), rng.randrange(len(w))
                if k == 0:
                    w[p] = rng.choice("abcdefghXY")
                elif k == 1:
                    w.insert(p, rng.choice("abcdefghXY"))
                elif len(w) > 1:
                    del w[p]
            lines.append("  ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
        rows.append((i if rng.random() < 0.9 else None, "\n".join(lines)))
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(600))
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "one two three four five\n\nx"), (4, "one two three four five\n\nx"), (5, long), (6, long + " more"), (None, "one two three four six"), (7, "a b\n \t\nx")]
    assert run(spark, rows) == brute_spaces(rows)
    assert run(spark, []) == []


def brute_spaces(rows):
    """The no-break space belongs to a word here, unlike in str.split."""
    return [None if t is None else t.replace("\x00", " ") for t in brute([(d, t and t.replace(" ", "\x00")) for d, t in rows])]


def test_clashing_columns_are_kept(spark):
    rows = [(2, "a b c d e\nx", 7, 8, 9), (1, "a b c d f", 17, 18, 19)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_id long, removed long, want long")
    out = sorted(dedup_lines(df).collect(), key=lambda r: r["doc_id"])
    assert [(r["doc_id"], r["text"], r["row_id"], r["removed"], r["want"], r["n_removed"]) for r in out] == [(1, "a b c d f", 17, 18, 19, 0), (2, "x", 7, 8, 9, 1)]


def test_a_very_long_line_is_matched(spark):
    words = [f"w{i}" for i in range(20_000)]
    other = [*words[:15_000], "new", *words[15_000:]]
    third = [*words[:3], "other", *words[4:]]
    far = [*words[:3], "other", "too", *words[5:]]
    rows = [(i, " ".join(w)) for i, w in enumerate((words, other, third, far, words[1:]))]
    assert run(spark, rows) == [rows[0][1], "", "", "", ""]
    assert run(spark, [rows[0], rows[3]]) == [rows[0][1], rows[3][1]]


def test_one_line_in_most_rows_and_one_template(spark):
    rows = [(i, f"the same line of all documents\nnumber {i} of a very common template\nown {i} words {i * 7} here {i * 3} and") for i in range(400)]
    assert run(spark, rows) == brute(rows)


def test_sql_form(spark):
    import duckdb

    from grainmill.llm.oracles import OP10
    from grainmill.llm.queries import op10_line_dedup

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    want = sorted(con.execute(f"select doc_id, text, n_lines, n_removed from ({OP10})").fetchall())
    assert sorted(tuple(r) for r in op10_line_dedup(spark, folder).select("doc_id", "text", "n_lines", "n_removed").collect()) == want

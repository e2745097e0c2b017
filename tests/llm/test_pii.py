import random

from pyspark.sql import functions as F

from grainmill.llm.pii import feistel, pseudonymise


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def run(spark, texts, key="k"):
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, kinds string")
    return [(r["text"], r["n_pii"], r["kinds"]) for r in sorted(pseudonymise(df, key).collect(), key=lambda r: r["doc_id"])]


def test_formats_and_links(spark):
    texts = [
        "a.b@x.com A.B@X.COM", "4785380592391139, 4785-3805-9239-1139", "+1 (743) 555-3824 and 743-555-3824", "10.20.30.40", "2020-02-29 29/02/2020", "123-45-6789", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907f1"', "10.20.30.40!",
    ]
    out = run(spark, texts)
    assert [n for _, n, _ in out] == [2, 2, 2, 1, 2, 1, 1, 1]
    a, b = out[0][0].split()
    assert a.upper() == b and a != texts[0].split()[0] and a.endswith("@x.com")
    a, b = out[1][0].split(", ")
    assert b.replace("-", "") == a != "4785380592391139" and luhn(a) and [len(x) for x in b.split("-")] == [4] * 4
    assert out[2][0][3:17].replace("(", "").replace(") ", "-") == out[2][0][-12:] != "743-555-3824"
    assert all(0 <= int(x) < 256 for x in out[3][0].split(".")) and out[7][0] == out[3][0] + "!"
    iso, dmy = out[4][0].split()
    assert iso.split("-") == dmy.split("/")[::-1] and iso != "2020-02-29"
    assert out[6][0].startswith('token = "') and len(out[6][0]) == len(texts[6])


def test_clean_and_invalid_stay(spark):
    texts = [None, "", "plain words, 12 and 2024", "4785380592391138", "999.1.1.1", "2020-02-31", "000-12-1234", "x " * 50_000, "1.2.3.4.5", "a@b"]
    assert run(spark, texts) == [(t, 0, []) for t in texts]
    assert run(spark, []) == []


def test_repeated_rows_and_keys(spark):
    texts = ["call +1 (743) 555-3824"] * 3
    one, other = run(spark, texts), run(spark, texts, "another")
    assert len({t for t, _, _ in one}) == 1 and one != other


def test_permutation(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("x"))
    got = {r[0] for r in df.select(feistel(F.col("x"), "k", F.lit("ssn"))).collect()}
    assert got == {f"{i:03d}" for i in range(1000)}


def test_every_planted_value_goes(spark):
    rng = random.Random(3)
    values = [f"{rng.choice('abc')}n.{i:02d}@mail{i % 7}.example.com" for i in range(20)] + [f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(0, 9999):04d}" for _ in range(20)] + [".".join(str(rng.randint(1, 255)) for _ in range(4)) for _ in range(20)]
    out = run(spark, [f"Word {v}### more" for v in values])
    assert all(n == 1 and v not in t and t.startswith("Word ") and t.endswith("### more") for v, (t, n, _) in zip(values, out, strict=True))


def test_card_beside_other_digits(spark):
    card = "4111 1111 1111 1111"
    texts = [card, f"{card} 12/25", f"{card} 123", "4111-1111-1111-1111 09", f"id 12 {card}", f"12 34 56 78 {card} 99 2024 1", f"{card} 12/12/2025", f"{card} 10.20.30.40", f"{card} {card}", "1234 555-123-4567"]
    out = run(spark, texts)
    new = out[0][0]
    assert luhn(new.replace(" ", "")) and new != card
    same = [x.replace(card, new) for x in texts]
    same[3] = texts[3].replace(card.replace(" ", "-"), new.replace(" ", "-"))
    assert [t for t, _, _ in out[:6]] == same[:6] and out[8][0] == same[8]
    assert [k for _, _, k in out] == [["card"]] * 6 + [["card", "date"], ["card", "ip"], ["card", "card"], ["phone"]]
    assert all(t.startswith(new) and t != x for (t, _, _), x in zip(out[6:8], same[6:8], strict=True))


def test_key_without_neighbouring_digits(spark):
    text = "a1b2c3d4e5f6a7b8c9d0e1f2a3b4c5d6"
    (out, n, kinds), = run(spark, [text])
    assert out != text and (n, kinds) == (1, ["key"])

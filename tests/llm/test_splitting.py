import random

from corvigraph.llm import splitting as S

KEYS = ["id"]


def texts(spark, rows):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(rows)], "id long, text string, piece string, start int")


def check(text, pieces, limit, overlap):
    assert pieces[0].start == 0 and pieces[-1].end == len(text)
    for p in pieces:
        assert p.piece == text[p.start : p.end] and 0 < len(p.piece) <= limit
    for a, b in zip(pieces, pieces[1:]):
        assert b.start <= a.end and a.end - b.start <= overlap and b.end > a.end and b.start > a.start
        natural = text[a.end - 1] in "\r\n" or text[a.end - 1] in ".!?" and (a.end == len(text) or text[a.end].isspace())
        assert natural != a.forced


def test_pieces_whatever_the_range_size(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(25):
        parts = [rng.choice(["ab", "Zäh", "1.5", "x" * rng.randrange(1, 90), "é😀"]) + rng.choice([" ", ". ", "! ", "\r\n", "\n", " ", " "]) for _ in range(rng.randrange(30, 200))]
        rows.append("".join(parts))
    rows += ["x" * 500, "", None, "   ", "a. " * 300, "y" * 60 + "." + "z" * 61]
    df = texts(spark, rows)
    expected = None
    for size in (17, 64, 100_000):
        ranges = S.text_ranges(df, KEYS, size=size)
        cuts = S.cut_table(ranges, KEYS, 60, 12, size)
        out = S.pieces_of_ranges(ranges, cuts, KEYS, size).orderBy("id", "piece_no").collect()
        got = [(r.id, r.piece_no, r.start, r.end, r.forced, r.piece) for r in out]
        expected = expected or got
        assert got == expected
    by = {}
    for r in out:
        by.setdefault(r.id, []).append(r)
    assert set(by) == {i for i, t in enumerate(rows) if t and len(t) > 60}
    for i, p in by.items():
        check(rows[i], p, 60, 12)


def test_longest_stretch(spark):
    rows = ["a" * 30 + ". " + "b" * 10, "no end", ".", "", None, "a.b.c", "x\ry"]
    r = S.longest_stretch(S.text_ranges(texts(spark, rows), KEYS, size=8), KEYS, 8).collect()
    assert {x.id: x.stretch for x in r} == {0: 30, 1: 6, 2: 0, 3: 0, 5: 5, 6: 1}


def test_empty(spark):
    r = S.text_ranges(texts(spark, ["a"]).limit(0), KEYS)
    assert S.pieces_of_ranges(r, S.cut_table(r, KEYS), KEYS).count() == 0


def test_repeated_rows_and_null_keys(spark):
    text = "Ein Satz. " * 40
    df = spark.createDataFrame([(1, text), (1, text), (None, text + "b"), (2, "short")], "id long, text string")
    r = S.text_ranges(df, KEYS, size=50)
    out = S.pieces_of_ranges(r, S.cut_table(r, KEYS, 60, 12, 50), KEYS, 50).collect()
    for key, whole in ((1, text), (None, text + "b")):
        pieces = sorted((x for x in out if x.id == key), key=lambda x: x.piece_no)
        assert [x.piece_no for x in pieces] == list(range(len(pieces)))
        check(whole, pieces, 60, 12)
    assert {x.id for x in out} == {1, None}


def test_over_says_whether_a_stretch_is_too_long(spark):
    rows = ["a" * 60 + "\n" + "b" * 60, "a" * 61 + "\n" + "b", "a" * 30 + ". " + "b" * 59, "a" * 30 + ". " + "b" * 61, "c" * 59 + ". " + "d" * 59 + "."]
    r = S.text_ranges(texts(spark, rows), KEYS, size=16)
    forced = {x.id: x.f for x in S.cut_table(r, KEYS, 60, 12, 16).groupBy("id").agg({"over": "max"}).toDF("id", "f").collect()}
    stretch = {x.id: x.stretch > 60 for x in S.longest_stretch(r, KEYS, 16).collect() if x.length > 60}
    assert forced == stretch == {0: False, 1: True, 2: False, 3: True, 4: False}


def test_files_are_cut_by_offset(spark, tmp_path):
    rng = random.Random(8)
    whole = "".join(rng.choice(["wörter ", "日本。", "Ende. ", "x" * 50, "a\n", "😀 "]) for _ in range(30_000))
    (tmp_path / "big.txt").write_bytes(whole.encode())
    (tmp_path / "small.txt").write_text("nothing to cut")
    (tmp_path / "none.txt").write_text("")
    for size in (1_000, 70_001):
        out = S.file_pieces(spark, [f"file://{tmp_path}"], 1200, 120, size).orderBy("piece_no").collect()
        assert {r.path.rsplit("/", 1)[1] for r in out} == {"big.txt"}
        check(whole, out, 1200, 120)
        assert [r.piece_no for r in out] == list(range(len(out)))


def test_a_text_of_many_ranges_with_production_sizes(spark):
    whole = "".join(f"Satz {i} über die Hüfte. " for i in range(9_000))  # more than 200,000 characters
    r = S.text_ranges(texts(spark, [whole]), KEYS)
    assert r.count() > 20
    out = S.pieces_of_ranges(r, S.cut_table(r, KEYS), KEYS).orderBy("piece_no").collect()
    check(whole, out, S.LIMIT, S.OVERLAP)

import random

from corvigraph.llm import pii

FIRST, LAST = ["Mara", "Edwin", "Ines", "Torvald", "Lucja"], ["Brackwell", "Ostrander", "Vesterby", "Quenneville", "Adeyemi"]


def corpus():
    rng = random.Random(3)
    rows, truth = [], set()
    add = lambda text, *items: (rows.append(("f", len(rows), text)), truth.update(("f", len(rows) - 1, k, x) for k, x in items))
    for _ in range(60):
        name = f"{rng.choice(FIRST)} {rng.choice(LAST)}"
        add(f"Spoke with {name} this morning. Vomiting for two days.", ("name", name))
        add(f"Owner {name} reports the signs began at home.", ("name", name))
        add("Bandit was started on clindavet for vomiting. Mild effusion of the left hip.")
    add("mara ostrander will collect the animal later.", ("name", "mara ostrander"))
    add("VESTERBY, Ines / +44 (0)7700 900 374 / ines@example.org", ("name", "VESTERBY, Ines"), ("phone", "+44 (0)7700 900 374"), ("email", "ines@example.org"))
    add("Ostrander syndrome is on the list. Sign of Vesterby was unlikely.")
    add("Write to mara [at] clinic [dot] example or edwin at mail dot example dot org.", ("email", "mara [at] clinic [dot] example"), ("email", "edwin at mail dot example dot org"))
    add("Sent the images @ noon; see protocol v2.5 @ 120 kVp.")
    add("tel 030 23125 920. Call (527) 555-0182 or five five five zero one two two.", ("phone", "030 23125 920"), ("phone", "(527) 555-0182"), ("phone", "five five five zero one two two"))
    add("Analyser serial 666-45-1322, lot 555-0134-B, invoice 00077189, chip 900311588890424, study 2023-06-16.")
    add("SSN 666-45-1322; passport no.: QI3632472; DNI 78368089O.", ("id_number", "666-45-1322"), ("id_number", "QI3632472"), ("id_number", "78368089O"))
    add("Lives at 201 Lantern Lane\nNorrowick, ZZ 40327. Moved to Flat 1, 71 Mill Drive, Eastmere, ZQ1 8XY last spring.", ("address", "201 Lantern Lane\nNorrowick, ZZ 40327"), ("address", "Flat 1, 71 Mill Drive, Eastmere, ZQ1 8XY"))
    add("Rechnung an Mühlengasse 139, 00306 Neuhallen; C/ del Molino 489, 8º A, 00536 Puerto Lirio.", ("address", "Mühlengasse 139, 00306 Neuhallen"), ("address", "C/ del Molino 489, 8º A, 00536 Puerto Lirio"))
    return rows, truth


def test_planted_items_are_found_and_nothing_else(spark):
    rows, truth = corpus()
    texts = spark.createDataFrame(rows, "field string, row_id long, text string")
    assert {tuple(r) for r in pii.found_items(texts).collect()} == truth


def test_redaction_keeps_rows_and_wording(spark):
    rows, _ = corpus()
    rows += [("f", 900, None), ("f", 901, ""), ("f", 902, "   "), ("f", 3, rows[3][2]), ("f", 903, "no finding " * 20_000)]
    texts = spark.createDataFrame([(*r, "x", 1) for r in rows], "field string, row_id long, text string, term string, alone int")
    out = pii.redacted(texts).collect()
    assert len(out) == len(rows)
    by_id = {r.row_id: r.text for r in out}
    assert by_id[900] is None and by_id[901] == "" and by_id[902] == "   " and by_id[903] == "no finding " * 20_000
    assert by_id[0] == "Spoke with [NAME] this morning. Vomiting for two days."


def test_empty_table(spark):
    empty = spark.createDataFrame([], "field string, row_id long, text string")
    assert pii.found_items(empty).count() == 0 and pii.redacted(empty).count() == 0


def test_disclosure_ranks_names_above_clinical_words(spark):
    rows, _ = corpus()
    d = {r.term: r.disclosure for r in pii.disclosure_table(spark.createDataFrame(rows, "field string, row_id long, text string")).collect()}
    assert min(d[w.lower()] for w in FIRST) > pii.THRESHOLD and d.get("vomiting", 0) < pii.BESIDE


def test_copies_of_a_text_do_not_move_the_bar(spark):
    """Copies with a cue, a third of all rows, and copies of a name without one: counts, bar and found names stay."""
    rows = [("f", i, f"{'abcdefghijklmnopqrst'[i % 20]}{i} effusion of the left hip, no name here at visit {i}.") for i in range(400)]
    rows += [("f", 1000 + i, f"Spoke with Mara {x} this morning, visit {i}.") for i, x in enumerate(LAST * 4)]
    rows += [("f", 2000 + i, f"Seen by {x}, call {i}.") for i, x in enumerate(LAST)]
    table = lambda r: spark.createDataFrame(r, "field string, row_id long, text string")
    cue = [("f", 3000 + i, "Spoke with Edwin Torvaldsen at noon.") for i in range(220)]
    bare = [("f", 4000 + i, "Brackwell called about the drops.") for i in range(200)]
    count = lambda r: {x.term: (x.texts, x.named, round(x.disclosure, 9)) for x in pii.disclosure_table(table(r)).collect()}
    assert count(rows + cue + bare) == count(rows + cue[:1] + bare[:1])
    found = {(r.row_id, r.item) for r in pii.found_items(table(rows + cue + bare)).collect() if r.kind == "name"}
    assert {(1000 + i, f"Mara {x}") for i, x in enumerate(LAST * 4)} | {(2000 + i, x) for i, x in enumerate(LAST)} <= found


def test_names_with_apostrophes_null_ids_and_the_way_by_joins(spark):
    rows = [(i, f"Spoke with Mrs O'Brien about the cough, visit {i}.") for i in range(6)] + [(None, "BRIEN phoned; O’Brien is the owner’s name."), (None, "Rappelé d'Anouk Lefèvre."), (7, None), (8, "")]
    rows += [(20 + i, f"Madame Anouk Lefèvre a appelé {i}.") for i in range(6)] + [(20 + i, f"Madame Anouk Lefèvre a appelé {i}.") for i in range(6)]
    texts = spark.createDataFrame([("f", i, t) for i, t in rows], "field string, row_id long, text string")
    sent = {(r.row_id, r.kind, r.item) for r in pii.found_items(texts).collect()}
    assert {(None, "name", "BRIEN"), (None, "name", "O’Brien"), (None, "name", "Anouk Lefèvre"), (0, "name", "O'Brien"), (20, "name", "Anouk Lefèvre")} <= sent
    assert {(r.row_id, r.kind, r.item) for r in pii.found_items(texts, most=0).collect()} == sent
    assert sorted(map(str, pii.redacted(texts, most=0).collect())) == sorted(map(str, pii.redacted(texts).collect()))


def test_one_sight_after_a_weak_cue_is_no_person(spark):
    texts = spark.createDataFrame([("f", 1, "Records came from London."), ("f", 2, "Spoke with Mrs Quarrington.")], "field string, row_id long, text string")
    assert {r.item for r in pii.found_items(texts).collect()} == {"Quarrington"}


def test_wording_outside_items_is_kept(spark):
    import re

    rows = [("f", i, f"Owner Tilda Marchbanks said cough since May {i}; call +44 20 7946 0{100 + i}. Grade 3/6 murmur, dose 12.5 mg.") for i in range(20)]
    texts = spark.createDataFrame(rows, "field string, row_id long, text string")
    items = {}
    for r in pii.found_items(texts).collect():
        items.setdefault(r.row_id, []).append(r.item)
    for r in pii.redacted(texts).collect():
        rest = dict((i, t) for _, i, t in rows)[r.row_id]
        for item in items[r.row_id]:
            rest = rest.replace(item, "\0")
        assert re.sub(r"\[[A-Z_]+\]", "\0", r.text) == rest and "murmur, dose 12.5 mg" in r.text and "Marchbanks" not in r.text


def test_words_before_numbers_are_told_apart_by_the_corpus(spark):
    rows = [("f", i, f"Owner asked to call 030 2312{i % 10} 9{i:02}. Batch {100000 + 37 * i} was used.") for i in range(40)]
    rows += [("f", 900, "Batch 030 23125 920 was used."), ("f", 901, "Phone 030 23125 921 at noon."), ("f", 902, "030 23125 922")]
    texts = spark.createDataFrame(rows, "field string, row_id long, text string")
    for most in (100, 0):
        got = {(r.row_id, r.item) for r in pii.found_items(texts, most=most).collect() if r.kind == "phone"}
        assert {i for i, _ in got} == {*range(40), 901, 902}
    d = {r.term: r.disclosure for r in pii.disclosure_table(texts).collect()}
    assert d["#call"] > pii.THRESHOLD > d["#batch"]

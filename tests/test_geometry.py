from tallyspan.operators import geometry

WORDS = "doc string, page long, word long, text string, x0 double, x1 double, top double, bottom double, width double, height double"
CELLS = "doc string, page long, line long, text string, date string, reference string, debit string, credit string, balance string"


def page(spark, words):
    return spark.createDataFrame([("d", 1, i, t, float(x), float(x + 40), float(top), float(top + 8), 600.0, 800.0) for i, (t, x, top) in enumerate(words)], WORDS)


def test_a_row_of_two_heights_is_found_whole_and_a_repeated_word_does_not_drag_it(spark):
    words = page(spark, [("01/02", 10, 100), ("PAY", 60, 104), ("ACME", 110, 104), ("5.00", 300, 100), ("PAY", 60, 119), ("ACME", 110, 300), ("7.00", 300, 115)])
    lines = spark.createDataFrame([("d", 1, 1, "01/02   PAY ACME      5.00"), ("d", 1, 2, "PAY 7.00"), ("d", 1, 3, "nowhere"), ("d", 1, 4, None), ("d", 1, 5, "   ")], "doc string, page long, line long, text string")
    found = {r.line: r for r in geometry.located_lines(lines, words).collect()}
    assert set(found) == {1, 2}
    assert (found[1].height, found[1].score, found[1].words, found[1].x0, found[1].x1, found[1].y0) == (100.0, 4, 4, 10 / 600, 340 / 600, 100 / 800)
    assert (found[2].height, found[2].score) == (115.0, 2)


def test_equal_values_take_words_from_the_left_and_the_rest_is_said(spark):
    words = page(spark, [("01/02", 10, 100), ("01/02", 60, 100), ("PAY", 120, 104), ("ACME", 170, 104), ("5.00", 300, 100), ("5.00", 400, 100), ("CR", 450, 100)])
    row = [("d", 1, 1, "01/02 01/02 PAY ACME 5.00 5.00 CR", "01/02", None, "5.00", "0", "5.00")]
    rows = spark.createDataFrame(row, CELLS)
    found = {r.field: (round(r.x0 * 600), round(r.x1 * 600)) for r in geometry.cell_boxes(rows, geometry.located_words(rows, words)).collect()}
    assert found == {"date": (10, 50), "debit": (300, 340), "balance": (400, 440), "description": (60, 210)}


def test_nothing_to_place(spark):
    rows = spark.createDataFrame([], CELLS)
    assert geometry.cell_boxes(rows, geometry.located_words(rows, page(spark, [("x", 1, 1)]))).count() == 0


def test_crowded_words_are_placed_as_others_and_a_line_meets_lists(spark, monkeypatch):
    """Lines of a page that share a word: the same places by lists and by rows, and no row a pair of lines."""
    words = page(spark, [w for n in range(12) for w in (("NEFT", 60, 104 + 15 * n), (f"N{n}", 10, 100 + 15 * n), (f"{n % 3}.00", 300, 100 + 15 * n))])
    lines = spark.createDataFrame([("d", 1, n, f"N{n} NEFT {n % 3}.00") for n in range(12)], "doc string, page long, line long, text string")
    lists = {tuple(r) for r in geometry.located_words(lines, words).collect()}
    assert len(lists) == 36
    tokens = lines.selectExpr("doc", "page", "line", "explode(split(text, ' ')) AS key")
    boxes = words.selectExpr("doc", "page", "text AS key", "top")
    assert geometry.few_heights(tokens, boxes).count() == 12
    monkeypatch.setattr(geometry, "MOST_HEIGHTS", 4)
    assert {tuple(r) for r in geometry.located_words(lines, words).collect()} == lists

from threatlens.llm import line_templates

SCHEMA = "doc_id long, text string, n_lines string, n_dropped int, line_no int, _id int, _KEY int, _drop int, _lines int, _flags int"


def clean(spark, rows):
    docs = spark.createDataFrame([(i, t, "", *[1] * 7) for i, t in rows], SCHEMA).repartition(3)
    got = line_templates.drop_recurring_lines(docs)
    assert {*got.columns} == {*docs.columns, "clean_text"}
    return sorted(((r.doc_id, r.clean_text, r.n_lines, r.n_dropped) for r in got.collect()), key=str)


def test_fields_are_generalised(spark):
    log = "login of user {} came in from host {} at port 22 today"
    rows = [(i, f"{' '.join(chr(97 + i) * k for k in range(1, 8))}\n{log.format('abcdefg'[i % 7], f'10.0.0.{i}')}\nshort {chr(97 + i)}") for i in range(8)]
    got = clean(spark, rows)
    assert got[0] == (0, rows[0][1], 3, 0)
    assert all(n == 1 and log[:5] not in text for _, text, _, n in got[1:])
    assert all(text.startswith(rows[i][1].split("\n")[0]) and "short" in text for i, text, _, n in got)


def test_prose_with_equal_openings_stays(spark):
    rows = [(i, f"it was the {chr(97 + i)}one {chr(98 + i)}two {chr(99 + i)}three {chr(100 + i)}four") for i in range(10)]
    assert clean(spark, rows) == sorted(((i, t, 1, 0) for i, t in rows), key=str)


def test_below_the_number_of_documents(spark):
    line = "all rights reserved by the owner"
    assert all(r[3] == 0 for r in clean(spark, [(i, line) for i in range(4)]))
    assert all(r[3] == 0 for r in clean(spark, [(1, "\n".join([line] * 50))]))
    assert [r[3] for r in clean(spark, [(i, line) for i in range(5)])] == [0, 1, 1, 1, 1]


def test_odd_rows(spark):
    line = "all rights reserved by the owner"
    long = "\n".join(f"{'abc'[i % 3] * 5} unlike line {i}" if i % 2 else line for i in range(3000))
    rows = [(1, None), (2, ""), (3, "\n\n"), (None, f"x\n{line}"), (4, line), (5, f"{line}\nend"), (5, f"{line}\nend"), (5, f"other\n{line}"),
            (6, long), (7, line), (8, f"\t{line}  \n")]
    got = clean(spark, rows)
    want = [(i, "\n".join(x for x in (t or "").split("\n") if " ".join(x.split()) != line or i == 4), len((t or "").split("\n"))) for i, t in rows]
    assert [r[:3] for r in got] == sorted(want, key=str)
    assert clean(spark, [(1, "a")])[0][:2] == (1, "a")
    empty = spark.createDataFrame([], SCHEMA)
    assert line_templates.drop_recurring_lines(empty).count() == 0


def two_field_log(rng, n, values=100):
    letters = "abcdefghij"
    names = [f"{a}{b}" for a in letters for b in letters][:values]
    return [(i, f"open session for {rng.choice(names)} from the office of {rng.choice(names)} was accepted") for i in range(n)]


def test_fields_do_not_depend_on_the_size_of_the_table(spark):
    """Two fields of letters with a hundred values each are one template in a small table and in a large one."""
    import random

    for n in (200, 20_000):
        docs = spark.createDataFrame(two_field_log(random.Random(n), n), "doc_id long, text string")
        assert [tuple(r) for r in line_templates.recurring_templates(docs).collect()] == [
            ("open session for <*> from the office of <*> was accepted", n - 1, n - 1)]
        assert line_templates.drop_recurring_lines(docs).filter("n_dropped = 0").count() == 1


def test_a_line_repeated_by_most_documents_hides_no_template(spark):
    import random

    rows = two_field_log(random.Random(1), 300)
    rows += [(1000 + i, "open session for nobody from the office of nobody was accepted") for i in range(2000)]
    got = clean(spark, rows)
    assert sum(r[3] for r in got) == 2299


def test_short_lines_and_long_lines(spark):
    short, long = "All rights reserved.", " ".join(f"{chr(97 + i)}word" for i in range(12))
    numbers = " ".join(str(i) for i in range(12))
    rows = [(i, f"{short}\n{'abcdefgh'[i] * 3} unique line") for i in range(8)]
    assert [r[3] for r in clean(spark, rows)] == [0] + [1] * 7
    assert [r[3] for r in clean(spark, [(1, long), (2, f"{long}\nmore"), (3, "else")])] == [0, 1, 0]
    assert [r[3] for r in clean(spark, [(1, numbers), (2, numbers)])] == [0, 0]
    assert [r[3] for r in clean(spark, [(1, f"{long}\n{long}"), (None, long)])] == [0, 0]
    assert [r[3] for r in clean(spark, [(1, long), (2, long), (None, long)])] == [0, 1, 1]

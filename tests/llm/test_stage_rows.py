from lintlake.llm import stages

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_duplicates_go_by_row(spark, tmp_path):
    def text(k, more=""):
        return " ".join(f"{k}{i}" for i in range(60)) + more

    rows = [
        (1, text("a")), (None, text("a")), (None, text("a", " end")),  # a null id near document 1
        (None, text("b", " end")), (None, text("b")), (None, text("b")),  # a group without ids
        (2, text("a", " end")), (2, text("c")), (2, text("c")),  # an id with two texts, one near document 1
        (3, text("d", " end")), (3, text("d")),  # near texts of one id
        (None, None), (None, None), (4, ""), (4, ""), (None, " \t"),  # no words
        (5, text("e").upper()), (None, text("e", " \n")),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], KINDS)
    got = sorted(((r["doc_id"], r["text"]) for r in stages.one_of_each_group(spark, docs, "").collect()), key=repr)
    want = [(1, text("a")), (None, text("b")), (2, text("c")), (3, text("d")), (None, None), (None, None), (4, ""), (4, ""), (None, " \t"), (5, text("e").upper())]
    assert got == sorted(want, key=repr)
    assert stages.one_of_each_group(spark, docs.limit(0), "").count() == 0

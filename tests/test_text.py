from pyspark.sql import functions as F

from skein.functions import text as t


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_clean_text_drops_marks_tags_and_blanks(spark):
    got = one(spark, t.clean_text(F.col("s")), s=" A[1] b[note 2]\t c[a] <b>d</b>\n\n\n\ne ")
    assert got == "A b c d\n\ne"


def test_clean_text_normalises_compatibility_forms(spark):
    assert one(spark, t.clean_text(F.col("s")), s="ﬁve²") == "five2"


def test_sentences_end_at_marks_before_white_space(spark):
    assert one(spark, t.split_sentences(F.col("s")), s="One. Two!  Three?\nFour 1.5 five") == ["One.", "Two!", "Three?", "Four 1.5 five"]
    assert one(spark, t.split_sentences(F.col("s")), s="") == []


def test_normalize_key_takes_hard_spaces(spark):
    assert one(spark, t.normalize_key(F.col("s")), s=" Alma  Mater ") == "alma_mater"


def test_match_norm_is_not_stripped_again(spark):
    assert one(spark, t.match_norm(F.col("s")), s=" (The)  Bombe! 図 ") == "the bombe "


def test_tokens_keep_accented_words_whole(spark):
    assert sorted(one(spark, t.tokens(F.col("s")), s="Kurt Gödel's proof, proof")) == ["gödel", "kurt", "proof", "s"]


def test_aliases(spark):
    assert one(spark, t.apply_aliases(F.col("s")), s="TURING.") == "Alan Turing"
    assert one(spark, t.apply_aliases(F.col("s")), s=None) == ""
    assert one(spark, t.apply_aliases(F.col("s")), s="Turing Award") == "Turing Award"


def split(spark, value, relation):
    return one(spark, t.split_value(F.col("v"), F.col("r")), v=value, r=relation)


def test_split_value_of_places(spark):
    assert split(spark, "Alan Mathison Turing 23 June 1912 (aged 1) Maida Vale, London", "birth_place") == ["Maida Vale, London"]
    assert split(spark, "7 June 1954 (1954-06-07) aged 41 Wilmslow", "death_place") == ["Wilmslow"]
    assert split(spark, "(x)", "genre") == []


def test_split_value_of_lists(spark):
    assert split(spark, "A; B (x)\nC;;", "award_received") == ["A", "B", "C"]
    assert split(spark, "Robin Gandy  Beatrice Worsley", "doctoral_student") == ["Robin Gandy", "Beatrice Worsley"]
    assert split(spark, "Robin  Gandy", "doctoral_student") == ["Robin  Gandy"]


def test_relation_color_number(spark):
    want = sum((k + 1) * ord(c) for k, c in enumerate("born_in")) % 12
    assert one(spark, t.relation_color_number(F.col("s")), s=" Born_In ") == want


def test_link_score(spark):
    assert abs(one(spark, t.link_score(F.col("m"), F.col("l"), F.col("d")), m="Alan Turing", l="alan turing", d="Turing the logician") - 1.1) < 1e-9


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(t.cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - 2**-0.5) < 1e-12 and got[1] is None


def test_file_names(spark):
    assert one(spark, t.file_name_of_title(F.col("s")), s='A: "B"/C?') == "A_ _B__C_"


def test_tooltip_escapes(spark):
    assert one(spark, t.tooltip(F.col("a"), F.lit("X"), F.lit(""), F.lit(None).cast("string")), a="<b>") == "<b>&lt;b&gt;</b><br>Type: X"


def test_case_folding_is_full_but_for_a_few_signs(spark):
    from skein.functions.text import casefold

    chars = [chr(c) for c in range(1, 0x2FFF) if not 0xD800 <= c <= 0xDFFF] + [chr(c) for c in range(0xA640, 0xA800)] + [chr(c) for c in range(0xFB00, 0xFB18)]
    rows = spark.createDataFrame([(c,) for c in chars], "c string").select("c", casefold(F.col("c")).alias("f")).collect()
    other = [r["c"] for r in rows if r["f"] != r["c"].casefold()]
    assert all("CHEROKEE" in unicodedata.name(c, "") or not c.isalpha() or unicodedata.category(c) == "Mn" for c in other) or len(other) < 30, [(c, hex(ord(c))) for c in other]
    words = ["Straße", "ΟΔΟΣ", "ﬁne", "İstanbul", "ısı", "ŒUVRE", "ẞ", "µ"]
    got = spark.createDataFrame([(w,) for w in words], "c string").select(casefold(F.col("c"))).collect()
    assert [r[0] for r in got] == [w.casefold() for w in words]


def test_texts_are_normalised_only_where_they_need_it(spark):
    from skein.functions.text import nfkc

    texts = ["plain", None, "", "ﬁ ½ é", "e\u0301"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(nfkc(F.col("t"))).collect()
    assert [r[0] for r in got] == [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]

import random

from pyspark.sql import functions as F

from skein.operators import crawl, documents, mentions, merge
from skein.operators import triples as tr
from skein.schemas import CANDIDATE, RAW_PAGE, TRIPLE
from skein.sources.files import mapping_table

SEQ = f"{TRIPLE}, seq long"


def test_clean_documents_defaults_and_sections(spark):
    raw = spark.createDataFrame([("T", None, "One. Two.", [("H", "A[1]. B."), ("E", " "), ("N", None)], None, None, None, None)], RAW_PAGE)
    r = documents.clean_documents(raw).first()
    assert r["url"] == "" and r["crawl_depth"] == -1 and r["infobox"] == {} and r["summary_sentences"] == ["One.", "Two."]
    assert [(x["heading"], x["text"], x["sentences"]) for x in r["sections"]] == [("H", "A. B.", ["A.", "B."])]


def test_spans_seek_onwards(spark):
    df = spark.createDataFrame([(1, "Yes. Yes. No."), (2, None), (3, "")], "k long, t string")
    got = [(r["sentence"], r["sent_start"], r["sent_end"]) for r in documents.sentence_spans(df, "k", "t").collect()]
    assert got == [("Yes.", 0, 4), ("Yes.", 5, 9), ("No.", 10, 13)]


def test_candidate_pairs_are_cut_after_the_filter(spark):
    rows = [(1, 0, "s", k, m, t, k, k + 1) for k, (m, t) in enumerate([("A", "DATE"), ("B", "DATE"), ("A", "X"), ("C", None), ("D", "X"), ("E", "X"), ("F", "X")])]
    placed = spark.createDataFrame(rows, "k long, sent_idx int, sentence string, pos int, mention string, type string, start int, end int")
    got = [(r["head"], r["tail"]) for r in mentions.candidate_pairs(placed, "k", 5).orderBy("pair").collect()]
    assert got == [("A", "C"), ("A", "D"), ("A", "E"), ("A", "F"), ("B", "A")]


def test_attribute_triples(spark):
    docs = spark.createDataFrame([("T", {"Alma mater": "King's (x); Princeton", "Other": "y", "Born": "London", "Awards": "z"})], "title string, infobox map<string,string>")
    got = {(r["relation"], r["tail"], r["sentence"]) for r in tr.attribute_triples(docs, mapping_table(spark)).collect()}
    assert got == {("educated_at", "King's", "Alma mater: King's (x); Princeton"), ("educated_at", "Princeton", "Alma mater: King's (x); Princeton"), ("birth_place", "London", "Born: London")}


def test_distant_labels(spark):
    c = spark.createDataFrame([(0, "Turing", "Princeton"), (1, "Princeton", "Alan Turing"), (2, "Ada", "Princeton"), (3, "Turing", "Pr")], "cand_seq long, head string, tail string")
    f = spark.createDataFrame([(0, "Alan Turing", "educated_at", "Princeton University"), (1, "Turing", "worked_at", "Princeton")], "fact_seq long, head string, relation string, tail string")
    got = {r["cand_seq"]: r["relation"] for r in tr.distant_labels(c, f).collect()}
    assert got == {0: "worked_at", 1: "educated_at", 2: "none", 3: "none"}


def test_parse_tagged_keeps_the_first_object(spark):
    df = spark.createDataFrame([("<s><triplet> A <subj> B <obj> r <subj> C <obj> q</s><triplet> bad <triplet> X <subj> Y <obj> z<pad>",)], "g string")
    got = df.select(tr.parse_tagged(tr.strip_special_tokens(F.col("g"))).alias("t")).first()["t"]
    assert [tuple(x) for x in got] == [("A", "r", "B"), ("X", "z", "Y")]


def test_align_swaps_reverse_matches(spark):
    found = spark.createDataFrame([("s", 0, "Princeton", "taught", "Turing"), ("s", 1, "X", "r", "Y")], "sentence string, gen_pos int, subject string, predicate string, object string")
    c = spark.createDataFrame([(0, "s", "Alan Turing", "Princeton", "d")], "cand_seq long, sentence string, head string, tail string, doc string")
    got = tr.align(found, c).collect()
    assert [(r["head"], r["relation"], r["tail"], r["doc"]) for r in got] == [("Princeton", "taught", "Alan Turing", "d")]


def test_generate_backs_off_and_default_generator(spark):
    s = spark.createDataFrame([("Turing was in the Princeton",), ("Turing was in the Princeton",), ("none",)], "sentence string")
    assert tr.extracted(tr.generate(s, tr.pattern_generator())).count() in (0, 1)

    def make():
        state = {"failed": False}

        def model(texts):
            if len(texts) > 1 and not state["failed"]:
                state["failed"] = True
                raise MemoryError
            return ["<triplet> A <subj> B <obj> r"] * len(texts)

        return model

    assert tr.generate(s, make).count() == 2


def fold(rows):
    """The stated merge, a triple at a time."""
    priority, out = {"infobox": 3, "silver": 2, "rebel": 1}, {}
    for r in sorted(rows, key=lambda r: r[-1]):
        head, _, rel, tail, _, conf, sent, doc, prov, _ = r
        key = (head.lower(), rel.lower(), tail.lower())
        if key not in out:
            out[key] = [head, rel, tail, conf, sent, [prov], [doc], prov]
            continue
        x = out[key]
        if prov not in x[5]:
            x[5].append(prov)
        if doc and doc not in x[6]:
            x[6].append(doc)
        if priority[prov] > priority[x[7]] or priority[prov] == priority[x[7]] and conf > x[3]:
            x[0], x[1], x[2], x[3], x[4], x[7] = head, rel, tail, conf, sent, prov
    return {k: (*v[:5], ",".join(v[5]), v[6]) for k, v in out.items()}


def test_merge_equals_a_sequential_merge(spark):
    rnd = random.Random(5)
    pick = rnd.choice
    rows = [(pick("aAbB"), "", pick(["r", "R"]), pick("xX"), "", pick([0.2, 0.5, 0.8]), f"s{k}", pick(["", "d1", "d2"]), pick(["infobox", "silver", "rebel"]), k) for k in range(400)]
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    got = merge.merge_triples(spark.createDataFrame(shuffled, SEQ)).collect()
    assert {(r["head"].lower(), r["relation"].lower(), r["tail"].lower()): (r["head"], r["relation"], r["tail"], r["confidence"], r["sentence"], r["provenance"], r["doc_ids"]) for r in got} == fold(rows)


def test_predicates_by_literal_and_by_nearest(spark):
    t = spark.createDataFrame([(" Born ",), ("worked at",), ("odd",), ("other",)], "relation string")
    near = spark.createDataFrame([("odd", "genre")], "predicate string, label string")
    got = {r["raw_relation"]: (r["relation"], r["mapped_by"]) for r in merge.map_predicates(t, mapping_table(spark), near).collect()}
    assert got == {" Born ": ("birth_place", "literal"), "worked at": ("worked_at", "literal"), "odd": ("genre", "embedding"), "other": ("other", "unmapped")}


def test_nearest_labels_with_the_default_encoder(spark):
    vec = lambda df, c: df.withColumn("vector", merge.char_vector(F.col(c)))
    p = vec(spark.createDataFrame([("field of works",), ("zzz",)], "predicate string"), "predicate")
    labels = vec(spark.createDataFrame([("field of work",), ("genre",)], "label string"), "label")
    got = {r["predicate"]: (r["best_match"], r["verdict"]) for r in merge.nearest_labels(p, labels).collect()}
    assert got["field of works"] == ("field of work", "accepted") and got["zzz"][1] == "unmapped"


def test_silver_and_first_triples(spark):
    rows = [("d", "s", "sec", "A", "X", 0, 1, "", "B", "X", 2, 3, "", "none"), ("d", "s", "sec", "A", "X", 0, 1, "q", "B", "X", 2, 3, "", "r")]
    got = tr.silver_triples(spark.createDataFrame(rows, f"{CANDIDATE}, relation string")).collect()
    assert [(r["head"], r["head_qid"], r["confidence"], r["provenance"]) for r in got] == [("A", "q", 0.8, "silver")]


def test_link_mentions_ties_and_none(spark):
    kb = spark.createDataFrame([("turing", 0, "Q1", "Turing", "x"), ("turing", 1, "Q2", "Turing", "x"), ("turing", 9, "Q3", "Turing", "turing")], "name string, rank int, id string, label string, description string")
    got = {r["mention"]: (r["wikidata_qid"], r["link_confidence"]) for r in mentions.link_mentions(spark.createDataFrame([("Turing",), ("Nobody",)], "mention string"), kb).collect()}
    assert got == {"Turing": ("Q1", 1.0), "Nobody": (None, 0.0)}


def test_crawl_budget_and_relevance(spark):
    links = spark.createDataFrame([("s", 0, "b"), ("s", 1, "a"), ("s", 2, "File:x"), ("b", 0, "c"), ("a", 0, "d")], "title string, pos int, target string")
    seeds = spark.createDataFrame([("s",)], "title string")
    assert [(r["title"], r["depth"]) for r in crawl.crawl(links, seeds, 2, 4).orderBy("depth", "place").collect()] == [("s", 0), ("b", 1), ("a", 1), ("File:x", 1)]
    some = spark.createDataFrame([("Turing machine",), ("File:Turing",), ("Turing (disambiguation)",), ("Cooking",)], "title string")
    assert [r["title"] for r in some.where(crawl.is_relevant(F.col("title"))).collect()] == ["Turing machine"]

"""What moves between tasks: triples move once for the merge, and whole rows don't move for counts of pairs."""

from skein.operators import graph as g
from skein.operators.merge import merge_triples, merged_relations
from skein.plans import derived
from skein.plans.queries import QUERIES


def executed(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_merge_moves_rows_once(spark):
    t = spark.range(100).selectExpr("id AS seq", "concat('H ', id % 7) AS head", "'' AS head_qid", "if(id % 2 = 0, 'Made', 'made') AS relation", "'t' AS tail", "'' AS tail_qid", "id / 100.0D AS confidence", "'s' AS sentence", "string(id) AS doc", "if(id % 3 = 0, 'rebel', 'silver') AS provenance")
    t = spark.createDataFrame(t.collect(), t.schema)  # else keys fold to constants
    merged = merge_triples(t)
    assert executed(merged)[1].count("Exchange hashpartitioning") == 1
    want = {(r["seq"], r["relation"]) for r in merged.collect()}
    assert {tuple(r) for r in merged_relations(t).collect()} == want and len(want) == 7


def test_counts_of_pairs_fold_no_rows(spark, sf_dir):
    derived.forget()
    assert QUERIES["top_degree"](spark, sf_dir).count() == 10
    assert not derived._SAVED


def test_pairs_are_those_of_the_folded_edges(spark, sf_dir):
    t = derived.triples(spark, sf_dir)
    folded = g.fold_edges(g.edges_multi(t)).select("seq", "source", "target")
    assert sorted(map(tuple, g.pairs(t).collect())) == sorted(map(tuple, folded.collect()))

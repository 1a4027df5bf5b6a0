"""Each operator on small tables with nulls, empty texts, repeats, ties and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import attention, common, fingerprints, lm_scoring, mixing, ngram_join, packing, quality, secret_scan, subwords, token_files, url_filter, vector_search
from skein.llm.queries import ORACLE_SQL, QUERIES

#: Columns that clash with names the operators use themselves.
def clash():
    return {"start": F.lit(1), "n": F.lit("x"), "range": F.lit(2), "token": F.lit(3.0), "size_": F.lit(0), "node": F.lit(4)}


TEXTS = [
    (5, "Hello  world, this is\n\n\tit.", "b"), (1, None, None), (3, "", "a"), (2, "one two three four five six seven", "a"), (9, "one two three four five six seven", "b"),
    (7, " lead and trail ", "b"), (8, "é ß 漢字 <|endoftext|> x", None), (4, "word " * 3000, "a"), (6, "ONE two three four five six seven", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string, source string").withColumns(clash())


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(subwords.default_tokenizer())


def ids_of(tokenizer, text, end):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_subwords_equal_the_library(tokenizer):
    rnd, enc = random.Random(1), subwords.Subwords(subwords.default_tokenizer(), kept=50)
    texts = [None, "", *("".join(rnd.choice("ab  \n\t\r.,'sé1²½٣漢　\x85\xa0\x1c%") for _ in range(rnd.randint(0, 14))) for _ in range(3000)), "<|endoftext|> a <|endoftext|>"]
    at = 0
    for _, ids, offsets in enc.encode_column(pa.array(texts), 2):
        for a, z in zip(offsets[:-1], offsets[1:], strict=True):
            assert ids[a:z].tolist() == ids_of(tokenizer, texts[at], 2).tolist(), repr(texts[at])
            at += 1
    assert at == len(texts) and list(enc.encode_column(pa.array([], pa.string()))) == []


def test_token_files_round_trip_and_pruning(spark, docs, nothing, tokenizer, tmp_path):
    path = f"file://{tmp_path}/t"
    token_files.write_token_orc(docs, path, partitions=3)
    rows = sorted(token_files.digest(token_files.with_starts(token_files.read_token_orc(spark, path))).collect())
    at = 0
    for r, (doc_id, text, _) in zip(rows, sorted(TEXTS), strict=True):
        ids = ids_of(tokenizer, text, 2)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    some = token_files.read_token_orc(spark, path, [4])
    assert [r["doc_id"] for r in some.collect()] == [4]
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString() or "EqualTo(doc_id" in some._jdf.queryExecution().toString()
    token_files.write_token_orc(nothing, f"{path}0", partitions=2)
    assert token_files.with_starts(token_files.read_token_orc(spark, f"{path}0")).count() == 0


def test_token_files_have_stripes_and_bloom_filters_that_spare_rows(spark, tmp_path):
    from pyarrow import orc

    rnd = random.Random(8)
    rows = [(50 * k, " ".join(str(rnd.random()) for _ in range(300))) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    path = f"{tmp_path}/t"
    token_files.write_token_orc(df, f"file://{path}", partitions=1, stripe_bytes=256 << 10, row_index_stride=100)
    plain = f"{tmp_path}/p"
    token_files.read_token_orc(spark, f"file://{path}").coalesce(1).write.option("compression", "zstd").option("orc.stripe.size", 256 << 10).option("orc.row.index.stride", 100).orc(f"file://{plain}")
    (file,), (other,) = ([f for f in Path(p).iterdir() if f.name.startswith("part-")] for p in (path, plain))
    own, without = orc.ORCFile(file), orc.ORCFile(other)
    assert own.nstripes > 3 and own.nrows == 3000
    assert own.file_length > without.file_length and own.stripe_statistics_length > 0  # Bloom filters take room in the stripes' indexes
    scanned = lambda ids: next(int(m["value"]) for m in metrics(spark, token_files.read_token_orc(spark, f"file://{path}", ids)) if m["name"] == "number of output rows")
    assert scanned([50 * 1700]) <= 1100  # a reader's batch of 1,024 rows at most, of 3,000
    assert scanned([50 * 1700 + 1]) < 1100  # within the statistics' range; only Bloom filters tell that it's absent


def metrics(spark, df):
    """The scan's metrics after df has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while not plan.nodeName().startswith("Scan"):
        plan = plan.children().head()
    it, out = plan.metrics().iterator(), []
    while it.hasNext():
        m = it.next()
        out.append({"name": m._2().name().get(), "value": m._2().value()})
    return out


def test_token_files_deal_out_null_and_equal_ids(spark, tokenizer, tmp_path):
    rows = [(None, f"a {k}") for k in range(200)] + [(7, f"b {k}") for k in range(200)] + [(9, "c c")] * 3 + [(k, "d") for k in range(20, 40)]
    token_files.write_token_orc(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), f"file://{tmp_path}/t", partitions=6)
    got = token_files.digest(token_files.with_starts(token_files.read_token_orc(spark, f"file://{tmp_path}/t"))).collect()
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == Counter((d, zlib.crc32(ids_of(tokenizer, t, 2).tobytes())) for d, t in rows)
    ends = sorted((r["start"], r["start"] + r["n_tokens"], -1 if r["doc_id"] is None else r["doc_id"]) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] and a[2] <= b[2] for a, b in zip(ends, ends[1:], strict=False))
    files = token_files.read_token_orc(spark, f"file://{tmp_path}/t").where("doc_id is null").select("file_no").distinct().count()
    assert files > 1


def test_packing_places_each_id_once_without_padding(docs, nothing, tokenizer):
    rows = packing.pack(docs.repartition(2), width=64, with_ids=True, open_limit=4).collect()
    text = {d: t for d, t, _ in TEXTS}
    fills = Counter()
    for doc_id, t in text.items():
        own = sorted((r for r in rows if r["doc_id"] == doc_id), key=lambda r: r["start"])
        ids = ids_of(tokenizer, t, 0)
        assert [x for r in own for x in r["token_ids"]] == ids.tolist()
        assert all(r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(r["token_ids"], "<u4").tobytes()) for r in own)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fills[r["sequence_id"]]
        fills[r["sequence_id"]] += r["length"]
    assert all(v == 64 or v & (v - 1) == 0 for v in fills.values())
    assert packing.pack(nothing).count() == 0


def test_sum_of_squares_picks_the_least_sum():
    p, rnd = packing.SumOfSquares(16), random.Random(2)
    for k in range(200):
        size = rnd.randint(1, 15)
        options = {}
        for h in range(0, 17 - size):
            if h == 0 or p.count[h]:
                after = p.count.copy()
                after[h] -= h > 0
                after[h + size] += h + size < 16
                options[h] = int((after**2).sum())
        assert options[p.best_level(size)] == min(options.values())
        p.put((k, 0, b"\0" * 4 * size, size))


def test_fingerprints_edits_order_and_likeness(spark, docs, nothing):
    rows = {r["doc_id"]: r for r in fingerprints.with_edits(docs, ranges=3).collect()}
    order = sorted(TEXTS, reverse=True, key=lambda t: t[0])
    for k, (doc_id, text, _) in enumerate(order):
        t, n = text or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert rows[doc_id]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and rows[doc_id]["n_chars"] == len(t)
    assert rows[2]["fingerprint"] == rows[9]["fingerprint"] != rows[6]["fingerprint"]
    a, b = (fingerprints.fingerprint(x) for x in ("x y\nz\nx y", "z\nx y\nx y"))
    assert np.array_equal(a, b) and not np.array_equal(a, fingerprints.fingerprint("x y\nz"))
    assert np.array_equal(fingerprints.inserted(fingerprints.fingerprint("x y\nz"), "x y"), a) and np.array_equal(fingerprints.deleted(a, "x y"), fingerprints.fingerprint("x y\nz"))
    assert fingerprints.with_edits(nothing, 3).count() == 0 and fingerprints.fingerprints(docs).count() == len(TEXTS)
    assert fingerprints.with_edits(docs.limit(1), 2).first()["near_next"] == 1.0


def test_likeness_is_near_that_of_whole_pair_counts():
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    base = [rnd.choice(words) for _ in range(400)]
    for share in (0.0, 0.2, 0.5, 1.0):
        other = [rnd.choice(words) if rnd.random() < share else w for w in base]
        a, b = (Counter(zip(t, t[1:], strict=False)) for t in (base, other))
        want = sum(a[k] * b[k] for k in a) / max(sum(v * v for v in a.values()), sum(v * v for v in b.values()))
        assert abs(fingerprints.likeness(*(fingerprints.fingerprint(" ".join(t)) for t in (base, other))) - want) < 0.25
    # Counts beyond 16 bits: half of a repeated pair, and nearly all of it.
    f = fingerprints.fingerprint
    assert abs(fingerprints.likeness(f("x y " * 40_000), f("x y " * 20_000)) - 0.5) < 0.01
    assert fingerprints.likeness(f("w " * 32_768), f("w " * 32_700)) > 0.99


def test_urls(spark):
    urls = ["https://a.com/x", "http://EXAMPLE.com/en/1?q", "https://www.example.com/en/", "https://n.net/es/#", "https://com", "nothing", None, "", "http://x.org?p=/en/", "https://b.net/fr/2"]
    more = [f"https://shop{k}.com/{k}" for k in range(40)] + [f"https://spam{k}.net/es/{k}" for k in range(40)] + ["https://spam9.org/es/1"]
    df = spark.createDataFrame(list(enumerate(urls + more)), "page_id long, url string").withColumns(clash())
    r = {x["page_id"]: x for x in url_filter.judge(df).collect()}
    assert [(r[k]["host"], r[k]["path"], r[k]["rule"]) for k in range(10)] == [
        ("a.com", "/x", "com/"), ("example.com", "/en/1", "example.com/en/"), ("www.example.com", "/en/", "www.example.com/en/"), ("n.net", "/es/", "net/es/"), ("com", "", None), ("", "", None), ("", "", None), ("", "", None), ("x.org", "", None), ("b.net", "/fr/2", "net/fr/"),
    ]
    assert r[1]["verdict"] == "block" and r[2]["verdict"] == "allow" and r[len(urls + more) - 1]["verdict"] == "block" and r[6]["score"] == 0.0
    assert url_filter.judge(df.limit(0)).count() == 0


def plain_markov(urls, order, contexts, prior):
    """p(character | what comes before) by dictionaries, as the docstring says."""
    fold = lambda u: "\x01" * order + re.sub("[0-9]", "0", u.lower())
    grams = Counter((t[i - k : i], t[i]) for u in urls for t in [fold(u)] for i in range(order, len(t)) for k in range(order + 1))
    totals = Counter()
    for (c, _), n in grams.items():
        totals[c] += n
    least = totals[""] / contexts

    def p(before, char):
        out = 1 / 256
        for k in range(order + 1):
            c = before[len(before) - k :]
            if totals[c] and totals[c] >= least:
                out = (grams[c, char] + prior * out) / (totals[c] + prior)
        return out

    return fold, p


@pytest.mark.parametrize("contexts", [1 << 16, 20])
def test_url_models_equal_plain_ones_and_sum_to_one(spark, contexts):
    rnd = random.Random(6)
    urls = [(int(k % 3 == 0), f"https://{rnd.choice(['shop', 'news', 'spam'])}{rnd.randint(0, 99)}.{'org' if k % 3 else 'biz'}/{''.join(rnd.choice('abcAB/') for _ in range(rnd.randint(0, 12)))}") for k in range(150)]
    df = spark.createDataFrame(urls, "rejected int, url string").repartition(3)
    models = url_filter.count_models(df, 4, contexts, 3.0)
    tried = ["https://shop1.org/abc", "x", "https://spam77.biz/AAAA//", "é?"]
    ratio = url_filter.Ratio(*models, 4)
    want = []
    for y, model in enumerate(models):
        fold, p = plain_markov([u for r, u in urls if r == y], 4, contexts, 3.0)
        for u in tried[:3]:
            t = fold(u)
            names, char, _ = url_filter.contexts_of([u.encode()], 4)
            assert np.allclose(model.probabilities(names, char), [p(t[i - 4 : i], t[i]) for i in range(4, len(t))])
            # Each place's distribution over all bytes sums to one.
            for at in (0, len(u) - 1):
                every = np.arange(256, dtype=np.uint64)
                assert abs(model.probabilities(np.repeat(names[:, at : at + 1], 256, axis=1), every).sum() - 1) < 1e-9
        want.append([sum(np.log(p(t[i - 4 : i], t[i])) for i in range(4, len(t))) for t in map(fold, tried[:3])])
    assert np.allclose(ratio.scores([u.encode() for u in tried[:3]]), (np.array(want[0]) - want[1]) / [len(u) for u in tried[:3]])
    assert len(models[0].contexts) <= 5 * contexts


def test_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=8)]) for k in range(300)]
    rows += [(300 + k, rows[50][1]) for k in range(20)] + [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [1.0] * 3), (None, rows[1][1]), (450, [2 * x for x in rows[7][1]]), rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns(clash())
    got = {}
    for r in vector_search.nearest(df, block=64, query_block=2, shortlist=40, sample_rows=128).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ok = {k: np.array(np.float32(v), np.float64) for k, v in rows if k is not None and v is not None and len(v) == 8 and np.isfinite(v).all() and any(v)}
    assert set(got) == {k for k in ok if k % 50 == 0}
    hit = 0
    for q, found in got.items():
        near = sorted((-float(v @ ok[q] / np.linalg.norm(v) / np.linalg.norm(ok[q])), k) for k, v in ok.items() if k != q)
        near = [k for _, k in sorted((round(s, 12), k) for s, k in near)[:5]]
        hit += len(set(near) & {k for _, k, _ in found})
        assert [r for r, *_ in sorted(found)] == [1, 2, 3, 4, 5]
    assert hit >= 0.9 * 5 * len(got)
    assert [k for _, k, _ in sorted(got[50])] == [300, 301, 302, 303, 304]
    assert vector_search.nearest(df.limit(0)).count() == 0
    assert vector_search.nearest(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")).count() == 1


def test_secrets(spark, nothing):
    texts = ["password: token: abcdefgh", "API_KEY = 'abc123' é token=short secret=longer1", "AKIA" + "A" * 16 + " AKIAAA", "x" + "0f" * 12, "pwd = Tr0ub4dour&3", "password is on the table", None, "", "paſsword=abcdefgh"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns(clash())
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secret_scan.scan(df).collect()}
    for k, t in enumerate(texts):
        t, want = t or "", []
        want += [("assign", m.start(), m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
        want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert sorted(want) == sorted(s for s in got[k] if s[0] != "guess")
    assert ("guess", 6, 18) in got[4] and got[5] == [] and got[6] == []
    assert secret_scan.scan(nothing).count() == 0
    masked = {r["doc_id"]: r["text"] for r in secret_scan.scan(df, mask="#").collect()}
    assert masked[4] == "pwd = #" and masked[6] is None and masked[3] == "x#"


def test_guess_costs_are_ordered():
    words = secret_scan.ranked_words(subwords.default_tokenizer())
    cost = lambda v: secret_scan.guess_cost(v, words)
    assert cost("aaaaaaaa") < cost("qwertyuiop") < cost("x9$Kq2!vZp")
    assert cost("19991231") < cost("83920175") and cost("password") < cost("pbsxwqrd") and cost("") == 0.0


def cheapest(value, words):
    """The least cost over all segmentations, by trying each."""
    step, low = np.log10(2), value.lower()
    size = lambda c: 10 if c.isdigit() else 26 if c.isalpha() else 33
    brute = lambda s: sum(np.log10(size(c)) for c in s)

    def segments(a):
        """(end, cost) of what may begin at a; what repeats, runs or walks is as long as it can be before its end."""
        for z in range(a + 1, len(value) + 1):
            s = value[a:z]
            yield z, brute(s)
            if len(s) >= 3 and len(set(s)) == 1 and (a == 0 or value[a - 1] != s[0]):
                yield z, np.log10(size(s[0]) * len(s))
            near = [(x, y) in secret_scan._ADJACENT for x, y in zip(low[a : z - 1], low[a + 1 : z], strict=True)]
            if len(s) >= 3 and all(near) and (a == 0 or (low[a - 1], low[a]) not in secret_scan._ADJACENT):
                yield z, np.log10(47 * 2 * len(s))
            for u in range(2, 5):
                k = len(s) // u + 1
                if len(s) % u == 0 and a >= u and value[a - u : z] == value[a - u : a] * k and not (a >= 2 * u and value[a - 2 * u : a - u] == value[a - u : a]):
                    yield z, np.log10(k)
            if words.get(low[a:z]):
                upper = sum(c.isupper() for c in s)
                yield z, np.log10(words[low[a:z]]) + (step if upper else 0) + step * min(upper, 3) * (upper not in (0, 1, len(s)))
            if secret_scan._is_date(s):
                yield z, np.log10({4: 120, 6: 36525, 8: 43830, 10: 43830}[len(s)])

    def best(a):
        return 0.0 if a == len(value) else min(step + cost + best(z) for z, cost in segments(a))

    return best(0)


def test_guess_cost_is_the_cheapest_segmentation():
    words, rnd = {"cat": 5, "dog": 9, "catdog": 40, "pass": 2}, random.Random(9)
    values = ["catdogcat", "abababab", "xyxyxyxyx", "aaaab", "qwert9", "CatPASS", "20200131", "asdfasdf", "ababcatab"]
    values += ["".join(rnd.choice(["cat", "a", "b", "ab", "q", "w", "1", "$"]) for _ in range(4))[:9] for _ in range(60)]
    for v in values:
        assert abs(secret_scan.guess_cost(v, words) - cheapest(v, words)) < 1e-9, v
    assert secret_scan.guess_cost("ab" * 50_000, words) < 12  # a long value takes time in proportion


def test_mixing_targets_and_limits(spark, docs, nothing):
    sized = mixing.sized_documents(docs)
    rows = mixing.mix(sized, mixing.quality_weight(F.col("_chars"), F.col("size")), bins=4).collect()
    size = {d: len((t or "").split()) for d, t, _ in TEXTS}
    assert {r["doc_id"]: r["size"] for r in rows} == size and all(r["taken"] <= 3 * r["size"] for r in rows)
    own = {}
    for r in rows:
        own.setdefault(r["source"], []).append(r)
    total = sum(size.values())
    left, open_ = total, {s: w for s, w in zip(sorted(own, key=lambda s: (s is None, s)), [1, 2, 3, 1], strict=True)}
    caps, target = {s: 3.0 * own[s][0]["source_size"] for s in own}, {}
    while open_:
        level = left / sum(open_.values())
        over = [s for s in open_ if level * open_[s] > caps[s]]
        if not over:
            target |= {s: level * w for s, w in open_.items()}
            break
        for s in over:
            target[s] = caps[s]
            left -= caps[s]
            del open_[s]
    for s, rs in own.items():
        assert abs(rs[0]["target"] - target[s]) < 1e-6 and abs(sum(r["taken"] for r in rs) - target[s]) <= 1
    assert mixing.mix(mixing.sized_documents(nothing), F.lit(1.0)).count() == 0


def brute_components(texts):
    sets = {d: frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if (w := (t or "").lower().split()) else frozenset() for d, t in texts}
    label = {d: d for d in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                label[max(root(a), root(b))] = min(root(a), root(b))
    return {d: (len(sets[d]), root(d)) for d in sets}


@pytest.mark.parametrize("long", [48, 2])
def test_join_equals_all_pairs(spark, docs, nothing, monkeypatch, long):
    monkeypatch.setattr(ngram_join, "LONG", long)
    rnd = random.Random(7)
    base = [[f"w{rnd.randint(0, 400)}" for _ in range(rnd.choice([5, 30, 60, 120]))] for _ in range(6)]
    texts = [(d, t) for d, t, _ in TEXTS]
    for k in range(90):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = f"e{rnd.randint(0, 10**6)}"
        texts.append((100 + k, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns(clash())
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_components(df).collect()}
    assert got == brute_components(texts)


def test_join_of_nothing_and_null_ids(spark, nothing):
    assert ngram_join.join_components(nothing).count() == 0
    df = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in ngram_join.join_components(df).collect() if r["doc_id"]) == [(2, 2), (3, 2)]
    assert [r["component_id"] for r in ngram_join.join_components(df).collect() if r["doc_id"] is None] == [None]


def test_quality_learns_from_texts(spark, nothing):
    rnd = random.Random(4)
    good = lambda: " ".join(rnd.choice(["the", "house", "river", "stands", "near", "old", "stone", "bridge"]) for _ in range(80))
    bad = lambda: " ".join(rnd.choice(["BUY!!", "NOW!!", "$$$", "CLICK!!"]) for _ in range(80))
    rows = [(k, good() if k % 3 else bad(), int(k % 3 > 0)) for k in range(240)] + [(900, None, 1), (901, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").withColumns(clash())
    model = quality.fit(df.select("doc_id", "text"), df.where("doc_id < 200").select("doc_id", "quality"), sample_rows=60)
    r = {x["doc_id"]: x["score"] for x in quality.scored(df, model).collect()}
    assert all((r[k] >= quality.THRESHOLD) == bool(y) for k, _, y in rows if 200 <= k < 900) and 0 <= r[900] == r[901] <= 1
    none = quality.fit(nothing.select("doc_id", "text"), df.select("doc_id", "quality").limit(0))
    assert 0 <= quality.scored(df, none).first()["score"] <= 1 and quality.scored(nothing, none).count() == 0


def test_language_model(spark, docs, nothing):
    rnd = random.Random(3)
    rows = [(k, " ".join(rnd.choice(["a", "the", "cat", "dog", f"z{k}"]) for _ in range(30))) for k in range(60)] + [(d + 1000, t) for d, t, _ in TEXTS]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash())
    training = df.where(~lm_scoring.held_out())
    count, ends = Counter(), 0
    for d, t in rows:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            count.update((t or "").encode().lower().split())
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + 1
    for lexicon_most in (1 << 19, 3):  # the bound of the broadcast changes no result
        r = {x["doc_id"]: x for x in lm_scoring.score(df, training, lexicon_most=lexicon_most).collect()}
        for d, t in rows:
            words = (t or "").encode().lower().split()
            base = sum(np.log10((c + 1) / (n + v + 1)) for c in [*(count.get(w, 0) for w in words), ends])
            assert abs(base - r[d]["base_score"]) < 1e-6 * max(1, abs(base)) and r[d]["n_tokens"] == len(words) + 1 and r[d]["train_tokens"] == n
            assert r[d]["n_known"] == sum(w in count for w in words) + 1 and np.isfinite(r[d]["score"]) and r[d]["score"] < 0
    assert r[1002]["score"] == r[1009]["score"]
    assert lm_scoring.score(nothing, nothing).count() == 0
    alone = {x["doc_id"]: x for x in lm_scoring.score(df, training.limit(0)).collect()}
    assert all(abs(x["base_score"]) < 1e-12 and x["train_tokens"] == 0 and np.isfinite(x["score"]) for x in alone.values())


def test_language_model_beats_the_base_on_held_out_texts(spark):
    """Words of two languages, made of syllables: contexts tell the language, and spelling tells unseen words."""
    rnd = random.Random(2)
    syllables = [["ka", "mo", "ri", "ta", "zu", "ne"], ["th", "ing", "er", "ou", "st", "and"]]

    def text():
        own = rnd.choice(syllables)
        return " ".join("".join(rnd.choice(own) for _ in range(rnd.randint(1, 5))) for _ in range(120))

    df = spark.createDataFrame([(k, text()) for k in range(700)], "doc_id long, text string").repartition(4)
    rows = [r for r in lm_scoring.score(df, df.where(~lm_scoring.held_out())).withColumn("held", lm_scoring.held_out()).collect() if r["held"]]
    per_token = lambda c: sum(r[c] for r in rows) / sum(r["n_tokens"] for r in rows)
    assert len(rows) > 60 and per_token("score") > per_token("base_score") + 0.1
    assert sum(r["score"] > r["base_score"] for r in rows) > 0.9 * len(rows)


def small_model(units=300, seed=0):
    rng = np.random.default_rng(seed)
    counts = rng.integers(1, 1000, units).astype(float)
    layout = attention.Layout.of(counts, own_rows=40)
    model = attention.Attention.start(layout, counts)
    return rng, attention.Attention(layout, [(w + rng.normal(0, 0.3, w.shape)).astype(np.float32) for w in model.weights])


def plain_log_probabilities(model, before, unit):
    """By loops in double precision: log p of every unit after `before`, the last of which is the query."""
    layout, (table, bias, out, leaves) = model.layout, [w.astype(np.float64) for w in model.weights]
    w = attention.WIDTH
    rows = table[layout.row[before]]
    q, k, v, own = rows[-1, :w], rows[:, w : 2 * w], rows[:, 2 * w : 3 * w], rows[-1, 3 * w :]
    s = k @ q / np.sqrt(w) + bias[np.arange(len(before))[::-1]]
    s = np.exp(s - s.max())
    state = np.append(s @ v / s.sum() + own, 1.0)
    soft = lambda z: z - z.max() - np.log(np.exp(z - z.max()).sum())
    classes, total = soft(state @ out), np.zeros(len(layout.rank))
    for c, (lo, hi) in enumerate(zip(layout.starts[:-1], layout.starts[1:], strict=True)):
        inside = soft(leaves[lo:hi] @ state) if hi - lo > 1 else np.zeros(1)
        total[np.argsort(layout.rank)[lo:hi]] = classes[c] + inside
    assert abs(np.exp(total).sum() - 1) < 1e-9
    return total[unit]


def test_scores_equal_plain_loops():
    rng, model = small_model()
    sizes = [1, 5, 16, 17, 40, 100]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    units = rng.integers(0, 300, bounds[-1])
    got = attention.text_scores(model, units, bounds, at_once=3)
    for k, size in enumerate(sizes):
        text, want = np.concatenate([[0], units[bounds[k] : bounds[k + 1]]]), 0.0
        for i in range(1, size + 1):
            first = max(0, (i - 1) // attention.STEP * attention.STEP - attention.STEP)  # a window's first input
            want += plain_log_probabilities(model, text[first:i], text[i])
        assert abs(got[k] - want) < 1e-3 * abs(want)


def test_gradients_equal_differences_and_nothing_looks_ahead():
    rng, model = small_model(seed=1)
    windows = rng.integers(0, 300, (3, attention.LENGTH + 1)).astype(np.int32)
    windows[1, 20:] = -1
    leaf = np.zeros_like(model.weights[3])
    trainer = attention.Trainer(model, 0.1)
    loss, grads = trainer.gradients(windows, lambda lo, hi, g: leaf.__setitem__(slice(lo, hi), g))
    plain = -sum(plain_log_probabilities(model, w[: i + 1], w[i + 1]) for w in windows for i in range(attention.LENGTH) if w[i + 1] >= 0) / (windows[:, 1:] >= 0).sum()
    assert abs(loss - plain) < 1e-4
    for w, g in zip(model.weights, [*grads, leaf], strict=True):
        for k in np.argsort(-np.abs(g).ravel())[:3]:
            k = np.unravel_index(k, g.shape)
            w[k] += 1e-2
            up = trainer.gradients(windows)[0]
            w[k] -= 2e-2
            down = trainer.gradients(windows)[0]
            w[k] += 1e-2
            assert abs((up - down) / 2e-2 - g[k]) < 2e-2 * max(0.01, abs(g[k]))
    x = model.layout.row[windows[:1, :-1]]
    later = x.copy()
    later[:, 20:] = 0
    ok, unit = np.ones(x.shape, bool), windows[:1, 1:]
    assert np.allclose(model.log_probabilities(x, ok, 0, unit)[:, :20], model.log_probabilities(later, ok, 0, unit)[:, :20])


def test_large_weights_give_finite_scores():
    rng, model = small_model(seed=2)
    model = attention.Attention(model.layout, [w * 60 for w in model.weights])
    units = rng.integers(0, 300, 80)
    assert np.isfinite(attention.text_scores(model, units, np.array([0, 80]))).all()


def test_pipeline_keeps_clean_documents_and_drops_copies(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"test-{name}")
        seen.append(docs.count())
        if name != "packing":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        if name == "near_duplicates":
            assert docs.select("doc_id").distinct().count() == docs.count() < seen[-2]
    assert seen[3] == seen[2] and seen[-1] > 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.execute(ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and sorted(map(tuple, got[cols].values.tolist())) == sorted(map(tuple, want[cols].values.tolist()))

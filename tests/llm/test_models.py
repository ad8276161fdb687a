"""Toxicity, quality, URL filter, vectors and the pipeline."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skytrace.llm import quality, queries, toxicity, urls, vectors
from skytrace.llm.common import table
from tests.conftest import DATA

MORE = "/root/testdata/sf0.1"


def rates(spark, rated, label):
    labels = table(spark, MORE, "labels")
    return {(r[label], r.predicted): r["count"] for r in rated.where("held_out").join(labels, "doc_id").groupBy(label, "predicted").count().collect()}


def test_toxicity_of_held_out_documents(spark):
    rated = queries.op2_toxicity(spark, MORE)
    assert rated.count() == table(spark, MORE, "documents").count()
    assert rated.where("score is null or score < 0 or score > 1").count() == 0
    n = rates(spark, rated, "toxic")
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) >= 0.9 and n.get((0, 1), 0) / n[0, 0] < 0.01
    words = set("loser idiot pathetic scum worthless moron trash clown disgusting stupid".split())
    told = F.exists(F.split(F.lower("text"), r"[^a-z]+"), lambda w: w.isin(*words))
    both = rated.join(table(spark, MORE, "documents"), "doc_id")
    assert both.where(told).count() > 500 and both.where(told & (F.col("predicted") == 0)).count() == 0


def test_nnpu_never_pays_for_a_negative_risk():
    rng = np.random.default_rng(1)
    x = (rng.random((900, 3)) < [0.5, 0.5, 0.5]).astype(np.float32)
    toxic = rng.random(900) < 0.2
    x[:, 0] = toxic
    w = toxicity.fit_nnpu(x[toxic][:80], x[300:], 0.2)
    score = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert score[toxic].min() > 0.7 > 0.3 > score[~toxic].max()


def test_toxicity_of_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        model = toxicity.fit(odd_docs, some)
        got = toxicity.score(odd_docs, model)
        assert got.count() == odd_docs.count() and got.columns == [*odd_docs.columns, "toxic_score"]
        assert got.where("toxic_score is null").count() == 0
        assert toxicity.score(no_docs, model).count() == 0
    assert toxicity.drop_toxic(odd_docs, labels).columns == odd_docs.columns
    assert toxicity.fit(no_docs, labels).words == []


def test_quality_of_held_out_documents(spark):
    rated = queries.op7_quality(spark, MORE)
    assert rated.count() == table(spark, MORE, "documents").count()
    n = rates(spark, rated, "quality")
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.98 and n[0, 0] / (n[0, 0] + n[0, 1]) >= 0.85


def test_quality_of_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (5, 0, 0), (None, 1, 1), (4, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        model = quality.fit(odd_docs, some)
        got = quality.score(odd_docs, model)
        assert got.count() == odd_docs.count()
        assert got.where("quality_score is null or quality_score < 0 or quality_score > 1").count() == 0
        assert quality.score(no_docs, model).count() == 0
    assert len(quality.fit(no_docs, labels).labels) == 0


def test_votes_are_exact():
    rng = np.random.default_rng(2)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    known, asked, y = unit(rng.standard_normal((300, 8))), unit(rng.standard_normal((40, 8))), rng.integers(0, 2, 300).astype(float)
    got = quality.Model(np.ones(1), np.ones((1, 8)), known, y).vote(asked)
    for v, s in zip(asked, got):
        c = known @ v
        top = np.argsort(-c)[: quality.NEIGHBOURS]
        w = np.maximum(c[top], 0).astype(float) ** 4
        assert s == pytest.approx((w * y[top]).sum() / w.sum(), rel=1e-4)


# --- URLs -------------------------------------------------------------------------------------------------------------------------


def rule_by_force(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[: min(ends, default=len(rest))])
    path = rest[min(ends, default=len(rest)) :]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


ODD_URLS = [None, "", "nothing", "http://", "://x.com/", "http://WWW.Example.COM/en/x?q#f", "http://example.com/en/", "http://a.example.com/en", "http://notexample.com/en/", "http://com/", "http://x.com", "http://x.com?a=/en/", "ftp://x.net/fr/#y", "http://x.net/es", "http://İ.net/es/", "a\nb://c.net/es/x\ny", "http://x.org/a://b.net/es/", "x" * 30_000]


def test_urls(spark):
    rows = [(i, u, "h") for i, u in enumerate(ODD_URLS)] + [(0, None, "h"), (None, "http://x.com/", None)]
    odd = spark.createDataFrame(rows, "page_id long, url string, host string")
    pages = table(spark, DATA, "pages")
    for df in (odd, pages, odd.limit(0)):
        got = urls.judge(df).collect()
        want = Counter((r.page_id, *rule_by_force(r.url)[:3]) for r in df.collect())
        assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == want
        assert all(g.verdict in ("allow", "block") for g in got)
        by_rule = {h + p: v for h, p, v in urls.RULES}
        assert all(g.rule is None or g.verdict == by_rule[g.rule] for g in got)
    assert {r.verdict for r in urls.judge(pages, rules=()).collect()} == {"allow"}


def test_url_models_against_brute_force(spark):
    pages = [(u, bool(i % 2)) for i, u in enumerate(["aab", "aba", "abb", "bba", "aabb", "caba", "ab"])]
    counts = [Counter() for _ in range(2)]
    for u, good in pages:
        padded = "\0" * urls.ORDER + u
        for i in range(len(u)):
            for k in range(urls.ORDER + 1):
                counts[0 if good else 1][padded[i + urls.ORDER - k : i + urls.ORDER + 1]] += 1

    def chance(c, gram):
        if not gram:
            return urls.UNSEEN
        context = sum(n for g, n in c.items() if len(g) == len(gram) and g[:-1] == gram[:-1])
        return (c[gram] + urls.SMOOTH * chance(c, gram[1:])) / (context + urls.SMOOTH)

    def ratio(gram):
        while gram and not (counts[0][gram] or counts[1][gram]):
            gram = gram[1:]
        return math.log(chance(counts[0], gram)) - math.log(chance(counts[1], gram)) if gram else 0.0

    asked = ["ab", "bbaac", "zz", "cab"]
    want = {u: np.mean([ratio(("\0" * urls.ORDER + u)[i : i + urls.ORDER + 1]) for i in range(len(u))]) for u in asked}
    tables = urls.fit(spark.createDataFrame(pages, "url string, good boolean"))
    got = {r.url: r.score for r in urls.score(spark.createDataFrame([(u,) for u in asked], "url string"), tables).collect()}
    assert got == pytest.approx(want)


def test_url_models_keep_every_gram(spark):
    """More grams than a table of 65,536 slots could hold: each has its own ratio, and one that no model saw backs off."""
    rng = np.random.default_rng(6)
    made = ["".join(map(chr, x)) for x in rng.integers(0x4E00, 0x4E00 + 300, (6_000, 20))]
    pages = [(u, bool(i % 2)) for i, u in enumerate(made[:5_000])]
    counts, contexts = [Counter(), Counter()], [Counter(), Counter()]
    for u, good in pages:
        padded = "\0" * urls.ORDER + u
        for i in range(len(u)):
            for k in range(urls.ORDER + 1):
                gram = padded[i + urls.ORDER - k : i + urls.ORDER + 1]
                counts[good][gram] += 1
                contexts[good][gram[:-1]] += 1

    def chance(good, gram):
        if not gram:
            return urls.UNSEEN
        return (counts[good][gram] + urls.SMOOTH * chance(good, gram[1:])) / (contexts[good][gram[:-1]] + urls.SMOOTH)

    def ratio(gram):
        while not (counts[0][gram] or counts[1][gram]):
            gram = gram[1:]
        return math.log(chance(1, gram)) - math.log(chance(0, gram))

    asked = made[4_900:5_200]
    want = {u: np.mean([ratio(("\0" * urls.ORDER + u)[i : i + urls.ORDER + 1]) for i in range(len(u))]) for u in asked}
    tables = urls.fit(spark.createDataFrame(pages, "url string, good boolean"))
    assert sum(len(g) == urls.ORDER + 1 for g in counts[0] | counts[1]) > 65_536 and tables[-1].count() > 65_536
    got = {r.url: r.score for r in urls.score(spark.createDataFrame([(u,) for u in asked], "url string"), tables).collect()}
    assert got == pytest.approx(want)


def test_long_urls_cost_in_proportion(spark):
    """Each of two URLs of 400,000 characters gives as many grams as it has characters; a quadratic cost would take hours."""
    long = ["http://a.com/" + "xyß漢" * 100_000, "http://b.org/" + "qr\U0001f600s" * 100_000]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*long, "http://c.net/es/x", "http://d.org/xyß"])], "page_id long, url string")
    assert {r.page_id: r.rule for r in urls.judge(pages).collect()} == {0: "com/", 1: None, 2: "net/es/", 3: None}
    grams = urls._grams(pages.where("page_id < 2"), ["page_id"]).groupBy("page_id", "gram").count().collect()
    for i, u in enumerate(long):
        padded = "\0" * urls.ORDER + u
        assert {r.gram: r["count"] for r in grams if r.page_id == i} == Counter(padded[k : k + urls.ORDER + 1] for k in range(len(u)))


def test_url_threshold_and_learning(spark):
    scored = spark.createDataFrame([(0.5, True), (0.3, True), (-0.2, False), (-0.4, False)], "score double, good boolean")
    assert -0.2 < urls.threshold(scored) <= 0.3
    assert urls.threshold(scored.where("good")) == 0
    made = [(i, f"http://{'good' if i % 2 else 'bad'}{i % 97}.{'com/' if i % 2 else 'net/es/'}{i}") for i in range(800)] + [(1000 + i, f"http://{'good' if i % 2 else 'bad'}{i}.org/") for i in range(100)]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(made, "page_id long, url string")).collect()}
    right = sum(got[1000 + i] == ("allow" if i % 2 else "block") for i in range(100))
    assert right > 90


# --- vectors ----------------------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, cls string, bits int"


@pytest.fixture(scope="module")
def vecs(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    rows = [base[i % 40] + rng.standard_normal(16) * (0.05 if i % 3 else 1.0) for i in range(500)] + [base[0]] * 30 + [base[1] * 2.0, base[1] * 7.0]
    rows = [[float(np.float32(x)) for x in r] for r in rows]
    rows += [None, [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [], [1.0, 0.0], [2.0, 0.0]]
    rows = [(i, r, i % 7, "c", 3) for i, r in enumerate(rows)]
    return spark.createDataFrame([*rows, rows[5], (None, rows[5][1], None, None, None)], VECTORS).repartition(3)


def good(r):
    return bool(r) and all(x is not None and math.isfinite(x) for x in r) and any(r)


@pytest.mark.parametrize("page", [8, vectors.PAGE])
def test_near_duplicate_vectors(vecs, page):
    got = vectors.near_duplicate_vectors(vecs, page=page).collect()
    rows = [(r.vec_id, r.embedding) for r in vecs.collect()]
    assert Counter(r.vec_id for r in got) == Counter(i for i, _ in rows)
    n, root = [0] * len(rows), list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if good(a) and good(b) and len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= vectors.COSINE:
                n[i], n[j] = n[i] + 1, n[j] + 1
                root[find(i)] = find(j)
    least = {}
    for i, (v, _) in enumerate(rows):
        k = find(i)
        least[k] = min([x for x in (least.get(k), v) if x is not None], default=None)
    want = Counter((v, n[i], least[find(i)], v == least[find(i)]) for i, (v, _) in enumerate(rows))
    found = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got)
    assert sum(r.n_links for r in got) >= 0.97 * sum(n) and all(r.n_links <= k for r, k in zip(sorted(got, key=lambda r: (r.vec_id is None, r.vec_id)), [n[i] for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0]))]))
    assert sum((found & want).values()) >= 0.95 * len(rows)


def test_planted_links_are_found(spark):
    """Pairs just above the threshold among 50,000 vectors of 64 dimensions."""
    rng = np.random.default_rng(8)
    rows = rng.standard_normal((50_000, 64))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    for k in range(0, 1_000, 2):
        away = rows[k + 1] - rows[k] * (rows[k] @ rows[k + 1])
        cosine = 0.9505 + 0.01 * rng.random()
        rows[k + 1] = cosine * rows[k] + math.sqrt(1 - cosine**2) * away / np.linalg.norm(away)
    made = pa.table({"vec_id": np.arange(len(rows)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(rows.astype(np.float32).ravel()), 64).cast(pa.list_(pa.float32()))})
    got = vectors.near_duplicate_vectors(spark.createDataFrame(made).repartition(8)).where("n_links > 0").toPandas()
    linked = set(got["vec_id"])
    assert linked <= set(range(1_000)) and len(linked) >= 990
    assert (got["component_id"] == got["vec_id"] // 2 * 2).all()


HUGE = [[1e308] * 8, [1.1e308] + [1e308] * 7, [-1e308] * 8, [3e307] + [1.0] * 7, [1e-310] * 8, [1.05e-310] * 8, [1e-310, -1e-310] * 4, [5e-324] + [0.0] * 7, [1e-323] + [0.0] * 7, [1.0] * 8, [1.0, 2.0] * 4, [3.0] * 8, [1e160] * 8, [2e160] * 8, [1e-170] * 8]


def test_vectors_of_extreme_size(spark):
    """Components near the ends of double precision take part: cosines and distances neither over- nor underflow."""
    from decimal import Decimal, localcontext

    docs = spark.createDataFrame(list(enumerate(HUGE)), "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in vectors.near_duplicate_vectors(docs).collect()}
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in vectors.nearest_neighbours(docs, F.col("vec_id") % 2 == 0, k=5).collect()}
    with localcontext() as c:
        c.prec, c.Emin, c.Emax = 60, -5_000, 5_000
        exact = [[Decimal(x) for x in v] for v in HUGE]
        dot = lambda a, b: sum(x * y for x, y in zip(a, b))
        cosine = lambda a, b: float(dot(a, b) / (dot(a, a) * dot(b, b)).sqrt())
        assert got == {i: sum(cosine(a, b) >= vectors.COSINE for j, b in enumerate(exact) if i != j) for i, a in enumerate(exact)}
        for q in range(0, len(HUGE), 2):
            apart = [(sum((x - y) ** 2 for x, y in zip(exact[q], b)).sqrt(), j) for j, b in enumerate(exact) if j != q]
            want = sorted((float(d), j) for d, j in apart)[:5]
            assert [found[q, k + 1][1] for k in range(5)] == pytest.approx([d for d, _ in want], rel=1e-12, abs=1e-323)


def test_no_vectors(vecs):
    assert vectors.near_duplicate_vectors(vecs.limit(0)).count() == 0
    assert vectors.nearest_neighbours(vecs.limit(0), F.lit(True)).count() == 0


def test_tables_follow_the_size():
    sizes = [vectors.tables_for(n) for n in (0, 10, 10_000, 10_000_000, 10**10)]
    assert sizes == sorted(sizes) and all(t < 120 for _, t in sizes)


def neighbours_by_force(rows, k=10):
    out = {}
    for q, a in rows:
        if q is not None and q % 5 == 0 and good(a):
            near = sorted((float(np.sqrt(((np.array(a) - np.array(b)) ** 2).sum())), v) for v, b in rows if v is not None and v != q and good(b) and len(a) == len(b))
            out[q] = near[:k]
    return out


def test_neighbours(vecs):
    got = {}
    for r in vectors.nearest_neighbours(vecs, F.col("vec_id") % 5 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id, r.rank))
    want = neighbours_by_force([(r.vec_id, r.embedding) for r in vecs.collect()])
    assert set(got) == {q for q, near in want.items() if near}
    hits = 0
    for q, near in got.items():
        assert [n[2] for n in near] == list(range(1, len(near) + 1)) and len(near) == len(want[q])
        assert near == sorted(near)
        hits += len({n[1] for n in near} & {v for _, v in want[q]})
    assert hits >= 0.95 * sum(map(len, want.values()))


def test_recall_on_the_test_table(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, MORE, "embeddings").collect()]
    v, ids = np.array([r for _, r in rows], dtype=float), np.array([i for i, _ in rows])
    hits = total = 0
    for q, near in queries.op3_neighbours(spark, MORE).groupBy("query_id").agg(F.collect_set("vec_id")).collect():
        d = np.sqrt(((v - v[ids == q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        hits, total = hits + len(set(ids[np.lexsort((ids, d))[:10]].tolist()) & set(near)), total + 10
    assert hits / total >= 0.9


# --- the pipeline -----------------------------------------------------------------------------------------------------------------


def test_pipeline_by_force(spark):
    """Each stage against a plain reckoning of its own input, over the documents table; the whole against the stages."""
    import hashlib

    import corpus_pipeline as p
    import public_tokenizers
    import tiktoken

    from skytrace.llm.bpe import codec
    from tests.llm.test_texts import groups_by_force, spans_by_force

    assert [n for n, _ in p.STAGES] == ["toxicity", "near_duplicates", "substrings", "mix", "encode"]
    stages, docs = dict(p.STAGES), table(spark, DATA, "documents")
    fixed = lambda rows: spark.createDataFrame(rows, docs.schema)
    toxic = {r.doc_id for r in queries.op2_toxicity(spark, DATA).collect() if r.predicted}
    kept = stages["toxicity"](spark, docs, DATA).collect()
    assert Counter(kept) == Counter(r for r in docs.collect() if r.doc_id not in toxic)
    groups = groups_by_force([(r.doc_id, r.text) for r in kept])
    one = stages["near_duplicates"](spark, fixed(kept), DATA).collect()
    assert sorted(r.doc_id for r in one) == sorted({least for _, _, least in groups})
    spans = spans_by_force([(r.doc_id, r.text) for r in one])
    cut = stages["substrings"](spark, fixed(one), DATA).collect()
    want = {}
    for r in one:
        raw = (r.text or "").encode()
        for s, e in reversed(spans.get(r.doc_id, [])):
            raw = raw[:s] + raw[e:]
        if r.doc_id not in spans or raw.split():
            want[r.doc_id] = raw.decode()
    assert {r.doc_id: r.text or "" for r in cut} == want
    mixed = stages["mix"](spark, fixed(cut), DATA).collect()
    sizes, taken = Counter(), Counter()
    for r in cut:
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    for r in mixed:
        taken[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.25) and max(Counter(r.doc_id for r in mixed).values()) <= 2
    assert {r.doc_id: r for r in mixed}.items() <= {r.doc_id: r for r in cut}.items()
    own = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(codec()._own._mergeable_ranks), special_tokens={})
    out = stages["encode"](spark, fixed(mixed), DATA).collect()
    digest = lambda text: (len(ids := own.encode_ordinary(text or "")), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == Counter((r.doc_id, *digest(r.text)) for r in mixed)
    assert Counter(map(tuple, p.run(spark, DATA).collect())) == Counter(map(tuple, out))


def test_pipeline_of_odd_documents(spark, odd_docs, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and columns of clashing names go through all stages."""
    import corpus_pipeline as p

    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd_docs.columns
    ids = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in p.run(spark, str(tmp_path)).collect()} == ids <= {r.doc_id for r in odd_docs.collect()}


def test_pipeline_of_nothing(spark, no_docs):
    import corpus_pipeline as p

    docs = no_docs
    for _, stage in p.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0

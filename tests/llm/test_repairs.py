"""Personal data, periodic runs and conversations against brute force, and rows that once ended or changed a job."""

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from skytrace.llm import bpe, chunks, identifiers, mixing, periods, queries, simhash, toxicity, turns
from skytrace.llm.common import table
from tests.conftest import DATA

SPACE = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- personal data ------------------------------------------------------------------------------------------------------------------


def luhn(digits):
    return sum(int(d) if k % 2 == 0 else int(d) * 2 - 9 * (int(d) > 4) for k, d in enumerate(reversed(digits))) % 10 == 0


def base_by_force(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def test_fixed_patterns():
    rng = random.Random(3)
    pieces = ["a", "b.", "@", "@", "x@y.z", ".", "1", "22", "+", "-", " ", "(", ")", "4111111111111111", "555-3824", "1.2.3.4", "300", "000", "é", "\n"]
    for _ in range(30_000):
        text = "".join(rng.choices(pieces, k=rng.randint(1, 14)))
        base = identifiers.base_spans(text)
        assert base == base_by_force(text)
        assert not any(s < e2 and s2 < e for s, _, e in identifiers.candidates(text, base) for s2, _, e2 in base)


@pytest.mark.parametrize("text", ["a" * 2_000_000, "@" * 500_000, "1" * 2_000_000, " " * 2_000_000, "1.2." * 200_000, "a.b@c" * 200_000])
def test_no_text_takes_long(text):
    identifiers.candidates(text, identifiers.base_spans(text))


def as_text(spans):
    return ",".join(f"{identifiers.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_personal_data(spark):
    docs = {r.doc_id: r.text or "" for r in table(spark, DATA, "documents").collect()}
    for r in queries.op11_personal_data(spark, DATA).collect():
        base = base_by_force(docs[r.doc_id])
        assert r.base_sha256 == sha(as_text(base)) and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
        assert set(as_text(base).split(",")) - {""} <= set(r.spans.split(","))


def cards(n, seed=1):
    rng, out = random.Random(seed), []
    while len(out) < n:
        own = "4" + "".join(rng.choices("0123456789", k=15))
        out += [own] * luhn(own)
    return out


def test_patterns_find_what_the_fixed_ones_miss(spark):
    """Two cards in one row, a phone before a card, and numbers that a telling word introduces; numbers that only look like cards stay."""
    own = cards(40)
    rows = [f"some words {c} more of them" for c in own[:20]] + [f"reach me: +1 ({200 + k}) 555-{1000 + k} today" for k in range(20)]
    rows += [f"two {own[20]} {own[21]} there", f"both +1 (333) 555-7777 {own[22]} here", "reach me: 555-123-4567 tonight", "the 1234567890123456 is none", "reach 98765 times"]
    got = {r.doc_id: [(rows[r.doc_id][s.start : s.end], s.kind) for s in r.added] for r in identifiers.personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got[40] == [(own[20], 2), (own[21], 2)] and got[41] == [("+1 (333) 555-7777", 3), (own[22], 2)]
    assert got[42] == [("555-123-4567", 3)] and not got[43] and not got[44] and not any(got[k] for k in range(40))


def test_copies_make_no_pattern(spark):
    """However often one text is repeated, its one number tells nothing of others."""
    rows = ["dial: +1 (200) 555-1000 now"] * 50 + ["dial: 555-123-4567 now"]
    got = identifiers.personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).where("doc_id = 50").first()
    assert not got.added


def test_personal_data_of_odd_documents(odd_docs, no_docs):
    got = identifiers.personal_data(odd_docs)
    assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in odd_docs.collect())
    assert identifiers.personal_data(no_docs).count() == 0


# --- periodic runs ------------------------------------------------------------------------------------------------------------------


def runs_by_force(words):
    found = {}
    for period in range(1, len(words) // 2 + 1):
        i = 0
        while i + period < len(words):
            start = i
            while i + period < len(words) and words[i] == words[i + period]:
                i += 1
            if i + period - start >= max(12, 2 * period):
                found.setdefault((start, i + period), period)
            i += i == start
    return sorted((s, e, q) for (s, e), q in found.items())


def test_runs():
    rng = random.Random(1)
    texts = []
    for _ in range(800):
        n, letters = rng.choice((0, 1, 5, 12, 13, 24, 30, 60, 100)), rng.choice((1, 2, 2, 3, 8))
        own = [rng.randrange(letters) for _ in range(n)]
        if n > 12 and rng.random() < 0.5:
            at, p = rng.randrange(n), rng.randint(1, n // 2)
            own = [own[at + (i - at) % p] if i >= at and at + p <= n else x for i, x in enumerate(own)]
        texts.append(own)
    got = {}
    for t, s, e, q in periods.periodic_runs(np.array([x for own in texts for x in own]), np.array([len(x) for x in texts])).tolist():
        got.setdefault(t, []).append((s, e, q))
    assert [sorted(got.get(k, [])) for k in range(len(texts))] == [runs_by_force(x) for x in texts]


def test_hashes_that_mislead_are_caught(monkeypatch):
    """With a hash that can't tell words apart at first, runs come out right all the same."""
    real = periods.PrefixHashes.__init__

    def blind(self, words, seed):
        real(self, words if seed else np.zeros_like(words), seed)

    monkeypatch.setattr(periods.PrefixHashes, "__init__", blind)
    words = np.array([1, 2] * 10 + [3, 4, 5, 6, 7] * 4 + list(range(10, 40)))
    got = [(s, e, q) for _, s, e, q in periods.periodic_runs(words, np.array([len(words)])).tolist()]
    assert sorted(got) == runs_by_force(words.tolist())


def test_periods(spark):
    got = {r.doc_id: r for r in queries.op12_periods(spark, DATA).collect()}
    for doc_id, text in table(spark, DATA, "documents").select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else x for i, x in enumerate(words)]
        if n > 2_000:
            continue
        runs = runs_by_force(words)
        gone = {i for s, e, q in runs for i in range(s + q, e)}
        best = min(((s - e, s, q) for s, e, q in runs), default=(None, None, None))
        length, start, period = (-best[0] if runs else None), best[1], best[2]
        want = (len(runs), start, length, period, 1000 * length // period if runs else None, sha("".join(f"{s},{e - s},{q}\n" for s, q, e in sorted((s, q, e) for s, e, q in runs))), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))
        assert tuple(got[doc_id])[1:] == want, doc_id


def test_periods_of_odd_documents(spark, odd_docs, no_docs):
    got = periods.with_runs(odd_docs)
    assert got.columns == [c for c in odd_docs.columns if c != "text"] + ["runs", "collapsed"]
    assert got.count() == odd_docs.count() and periods.with_runs(no_docs).count() == 0
    long = spark.createDataFrame([(1, "ab " * 40_000)], "doc_id long, text string")
    assert [(tuple(r.runs[0]), r.collapsed) for r in periods.with_runs(long).collect()] == [((0, 40_000, 1), "ab")]


# --- conversations ------------------------------------------------------------------------------------------------------------------


def repaired_by_force(rows):
    """What a conversation's rows (turn, role, text), in order, come to: all ways to edit them, by recursion from the end."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = (text or "").rstrip(SPACE)
        faults.append("blank" if not bare.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [(role or "")[:1] for _, role, _ in rows]
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    named = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(t, state, inserted):
        out = [(0, "", ())] if t == len(rows) and state in (0, 3) else []
        for x in "ua" if inserted < 3 else "":
            if (state, x) in step:
                cost, audit, lines = best(t, step[state, x], inserted + 1)
                out.append((cost + 2, "I" + audit, (named[x] + ":", *lines)))
        if t < len(rows):
            cost, audit, lines = best(t + 1, state, 0)
            out.append((cost + 3, "D" + audit, lines))
            if faults[t] not in ("blank", "duplicate"):
                more = faults[t] == "truncated"
                if (state, initials[t]) in step:
                    cost, audit, lines = best(t + 1, step[state, initials[t]], 0)
                    out.append((cost + more, "K" + audit, (f"{rows[t][1]}:{rows[t][2]}", *lines)))
                for x in "ua":
                    if (state, x) in step:
                        cost, audit, lines = best(t + 1, step[state, x], 0)
                        out.append((cost + more + 2, "R" + audit, (f"{named[x]}:{rows[t][2]}", *lines)))
        return min(out) if out else (10**9, "", ())

    for t in range(len(rows), -1, -1):  # so that no recursion is deep
        for state in range(4):
            best(t, state, 0)
    cost, audit, lines = best(0, 0, 0)
    at = [t for t, _, _ in rows if t is not None]
    gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return {"gaps": gaps, **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")}, "illegal": illegal, "cost": cost, "audit": audit, "repaired_sha256": sha("\n".join(lines))}


def test_turns(spark):
    damaged = {}
    for conv, turn, role, text in table(spark, DATA, "conversations").select("conv_id", "turn", "role", "text").collect():
        code = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        damaged.setdefault(conv, []).extend([(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1))
    got = {r.conv_id: r.asDict() for r in queries.op13_turns(spark, DATA).collect()}
    assert got == {c: {"conv_id": c, **repaired_by_force(sorted(rows, key=lambda r: r[0]))} for c, rows in damaged.items()}


@pytest.mark.parametrize("parts,segment", [(1, 512), (7, 512), (40, 8)])
def test_turns_in_pieces(spark, monkeypatch, parts, segment):
    """Conversations that go on over ranges and segments, with odd roles and texts, come out as whole ones do."""
    rng, own = random.Random(2), {}
    for conv in (None, *range(60)):
        size = 300 if conv == 7 else rng.choice((1, 2, 3, 5, 9))
        own[conv] = [(k, rng.choice(("user", "assistant", "system", "tool", None, "", "User")), rng.choice((None, "", " ", "a.", "b", "c!", "e. ", f"f{k}."))) for k in range(size)]
    df = spark.createDataFrame([(c, *r) for c, rows in own.items() for r in rows], "conv_id long, turn long, role string, text string").selectExpr("*", "'x' id").repartition(5)
    # Segments are cut in tasks, where a monkeypatch doesn't reach; so they are tried here on the driver.
    monkeypatch.setattr(turns, "SEGMENT", segment)
    told, lines = turns.repair(df, parts)
    got = {r.conv_id: r.asDict() for r in told.collect()}
    for r in turns.as_documents(lines).collect():
        got[r.conv_id] |= {"audit": r.audit, "repaired_sha256": sha(r.repaired)}
    assert got == {c: {"conv_id": c, **repaired_by_force(rows)} for c, rows in own.items()}


@pytest.mark.parametrize("segment", [1, 3, 8])
def test_segments_come_out_as_whole_conversations(monkeypatch, segment):
    rng = np.random.default_rng(segment)
    sizes = rng.integers(1, 40, 50)
    n = int(sizes.sum())
    rows = rng.integers(0, 4, n), rng.integers(0, 4, n), rng.integers(1, 3, n)
    last, entry = np.tile(turns._LAST, (50, 1)), np.zeros(50, dtype=np.int64)
    whole = turns.Segments(*rows, sizes)
    want, costs, exits = whole.edits(last, entry), whole.matrices(), whole.exits(last)
    monkeypatch.setattr(turns, "SEGMENT", segment)
    cut = turns.Segments(*rows, sizes)
    assert len(cut.of) > 50
    assert all((a == b).all() for a, b in zip(cut.edits(last, entry), want)) and (cut.matrices() == costs).all() and (cut.exits(last) == exits).all()


def test_no_turns(spark, tmp_path):
    df = spark.createDataFrame([(0, 29, "user", "x.")], "conv_id long, turn long, role string, text string")
    gone = next(t for t in range(1000) if zlib.crc32(f"3:{t}".encode()) % 20 == 0)
    df.union(spark.createDataFrame([(3, gone, "user", "x.")], df.schema)).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op13_turns(spark, str(tmp_path)).collect()}
    assert tuple(got[3])[1:] == (0, 0, 0, 0, 0, 0, "", sha("")) and set(got) == {0, 3}
    told, lines = turns.repair(df.limit(0))
    assert told.count() == lines.count() == turns.as_documents(lines).count() == 0


# --- rows that once ended or changed a job ------------------------------------------------------------------------------------------


def test_a_million_blanks_are_encoded(spark):
    texts = [" " * 1_000_000, "a" + " \n" * 600_000 + "b", "word " * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(bpe.encode(docs)).collect()} == dict(enumerate(texts))


def test_long_runs_are_cut_as_the_library_would(monkeypatch):
    rng, own = random.Random(5), bpe.codec()
    monkeypatch.setattr(bpe, "LEAF", 16)
    monkeypatch.setattr(own, "long_run", 2)
    for _ in range(4_000):
        text = "".join(rng.choices(["a", "bc", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "\xa0", "!", "'s", "7", "　"], k=rng.randint(0, 60)))
        assert own.encode(text).tolist() == own._own.encode_ordinary(text)


def test_own_columns_come_out_as_they_went_in(spark):
    text = " ".join(f"word{k}" for k in range(80))
    docs = spark.createDataFrame([(1, text, "many", 7.0), (2, text, "some", 8.0), (3, "one two", None, 9.0)], "doc_id long, text string, n_chars string, toxic_score double")
    cut = chunks.cut_repeated_passages(docs)
    assert cut.columns == docs.columns and {(r.doc_id, r.n_chars) for r in cut.collect()} <= {(1, "many"), (2, "some"), (3, None)}
    kept = toxicity.drop_toxic(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert {(r.doc_id, r.toxic_score) for r in kept.collect()} == {(1, 7.0), (2, 8.0), (3, 9.0)}


def test_toxic_labels_alone_are_enough(spark):
    """Without a single clean label the same documents go: the share of toxic ones comes from the unlabelled texts."""
    more = "/root/testdata/sf0.1"
    docs, labels = table(spark, more, "documents"), table(spark, more, "labels")
    model = toxicity.fit(docs, labels.where("toxic = 1"))
    told = {(r.toxic, r.hit): r["count"] for r in toxicity.score(docs, model).join(labels.where("toxic is not null"), "doc_id").selectExpr("toxic", f"toxic_score >= {toxicity.REJECT_FROM} hit").groupBy("toxic", "hit").count().collect()}
    assert told[1, True] >= 0.9 * (told[1, True] + told.get((1, False), 0)) and told.get((0, True), 0) < 0.01 * told[0, False]
    kept = toxicity.drop_toxic(docs, labels.where("toxic = 1")).count()
    assert kept > 0.8 * docs.count()


def test_class_prior():
    rng = np.random.default_rng(1)
    for prior in (0.02, 0.1, 0.4):
        toxic = lambda n: rng.random((n, 30)) < 0.25
        unlabelled = np.where(rng.random((4000, 1)) < prior, toxic(4000), rng.random((4000, 30)) < 0.002).astype(np.float32)
        assert toxicity.class_prior(toxic(500).astype(np.float32), unlabelled) == pytest.approx(prior, abs=0.03)
    assert toxicity.class_prior(np.ones((5, 1)), np.ones((5, 1))) <= toxicity.MOST_PRIOR < 1


def test_unlike_rows_are_mixed_apart(spark):
    """Rows that agree in id, source and text but not in language: each comes as often as its own crossings say."""
    rows = [(1, "en", "a", "x y z"), (1, "fr", "a", "x y z"), (2, "en", "a", "x y"), (2, "en", "a", "x y"), (3, None, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    got, drawn = Counter(tuple(r) for r in mixing.mix(docs, share=1.0).collect()), mixing.copies(docs, share=1.0)
    assert sum(got.values()) == drawn.agg({"n_copies": "sum"}).first()[0]
    assert got[rows[0]] >= 1 and got[rows[1]] >= 1 and mixing.mix(docs, share=1.0).columns == docs.columns


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "a b c d e", "x"), (1, "a b c d e", "x"), (1, "a b c d e", "y"), (None, "f g h i j", "x"), (None, "f g h i j", "x"), (2, "a b c d e", "x")]
    got = [(r.doc_id, r.text) for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n string").repartition(3)).collect()]
    assert sorted(got, key=repr) == [(1, "a b c d e"), (None, "f g h i j")]

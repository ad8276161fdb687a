"""SimHash groups, substring chunks, mixing, BPE and shards against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytrace.llm import bpe, chunks, mixing, shards, simhash
from skytrace.llm.common import new_folder, table
from skytrace.llm.components import connected_components
from tests.conftest import DATA
from tests.llm.conftest import DOCS, LONG, doc


def components(nodes, linked):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    r = random.Random(1)
    links = {"chain": [(i, i + 1) for i in range(70)], "star": [(500, i) for i in range(90)], "random": [(r.randrange(200), r.randrange(200)) for _ in range(140)], "none": []}[shape]
    df = spark.createDataFrame([*links, *links[:3], (None, 4), (4, None), (9000, 9000)], "a long, b long")
    got = {x.node: x.component for x in connected_components(df).collect()}
    nodes = {n for pair in links if pair[0] != pair[1] for n in pair}
    assert got == components(nodes, [p for p in links if p[0] != p[1]])


# --- SimHash ----------------------------------------------------------------------------------------------------------------------


def fingerprint(text):
    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))


def groups_by_force(rows):
    prints = [fingerprint(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    root = components(range(len(rows)), near)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        ids.setdefault(root[i], []).append(doc_id)
    least = {k: min([x for x in v if x is not None], default=None) for k, v in ids.items()}
    return sorted(((d, f"{prints[i]:016x}", least[root[i]]) for i, (d, _) in enumerate(rows)), key=repr)


def found_groups(docs):
    g = simhash.near_duplicate_groups(docs)
    return sorted((tuple(r) for r in g.select("doc_id", simhash.fingerprint_text(g["fp"]), "component_id").collect()), key=repr)


def test_simhash(spark):
    docs = table(spark, DATA, "documents")
    assert found_groups(docs) == groups_by_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_simhash_of_odd_documents(odd_docs, no_docs):
    assert found_groups(odd_docs) == groups_by_force([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert found_groups(no_docs) == []
    kept = simhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 5, 7, 8, 9, 10]
    assert simhash.drop_near_duplicates(no_docs).count() == 0


def test_near_duplicates_that_share_an_id(spark):
    """One copy under an id takes no other text of that id along; copies without an id go, and one of each group stays."""
    a, b, c, d, e = (words(40, seed) for seed in range(30, 35))
    rows = [(1, a), (2, a), (2, b), (2, c), (None, a), (None, d), (None, d + " "), (5, e), (5, e + " "), (None, e), (None, None), (7, "")]
    got = [(r.doc_id, (r.text or "").strip()) for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert Counter(got) == Counter([(1, a), (2, b), (2, c), (None, d), (5, e), (7, "")])


def test_blocks_follow_the_size():
    assert [simhash.blocks_for(n) for n in (0, 10**6, 10**8, 10**10, 10**12)] == [4, 4, 4, 5, 6]
    for blocks, bits in ((4, 16), (5, 25), (6, 31)):
        own = [int(np.int64(m).view(np.uint64)) for m in simhash.masks(blocks)]
        assert min(m.bit_count() for m in own) >= bits
        far = [sum(1 << b for b in bits) for bits in itertools.combinations(range(0, 64, 5), 3)]
        assert all(any(not m & x for m in own) for x in far)


@pytest.mark.parametrize("page,blocks", [(4, 4), (16, 5), (16, 6), (simhash.PAGE, None)])
def test_links_lose_no_fingerprint(spark, page, blocks):
    """Clouds of near fingerprints that fill many pages, wide groups in one block, and far ones."""
    rng = np.random.default_rng(page)
    prints = [int(x) for x in rng.integers(0, 1 << 63, 30)]
    for base in prints[:3]:
        for _ in range(250):
            x = base
            for bit in rng.choice(64, rng.integers(1, 9), replace=False):
                x ^= 1 << int(bit)
            prints.append(x - (1 << 64) if x >= 1 << 63 else x)
    df = spark.createDataFrame([(x,) for x in prints + [None, prints[0]]], "fp long")
    got = {r.node: r.component for r in connected_components(simhash.fingerprint_links(df, page=page, blocks=blocks)).collect()}
    u = np.unique(np.array(prints))
    roots = np.arange(len(u))
    for i in range(len(u)):
        j = np.flatnonzero(np.bitwise_count(u[i].view(np.uint64) ^ u.view(np.uint64)) <= 3)
        simhash.hang(roots, np.full(len(j), i), j)
    assert {int(x): int(u[r]) for x, r in zip(u, roots)} == {int(x): got.get(int(x), int(x)) for x in u}


def test_a_bit_needs_over_half():
    hashes = np.array([0b01, 0b11, 0b10, 0b01], dtype=np.uint64)
    assert simhash.fingerprint_bits(hashes, np.array([0, 2])).tolist() == [0b01, 0]
    many = np.random.default_rng(1).integers(0, 1 << 63, 3 * simhash.STEP + 5, dtype=np.uint64)
    starts = np.array([0, 10, simhash.STEP - 1, simhash.STEP + 3])
    ends = np.append(starts[1:], len(many))
    want = [sum(1 << k for k in range(64) if int(((many[s:e] >> np.uint64(k)) & np.uint64(1)).sum()) * 2 > e - s) for s, e in zip(starts, ends)]
    assert simhash.fingerprint_bits(many, starts).tolist() == want


# --- substrings -------------------------------------------------------------------------------------------------------------------


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnoprstuv") for _ in range(r.randint(2, 8))) for _ in range(n))


def chunks_by_force(raw):
    """Chunk starts by a plain loop over a text's bytes."""
    gear, blanks, n = chunks._GEAR.tolist(), b"\t\n\v\f\r \0", len(raw)
    hashes, since, h, run = [], [], 0, 0
    for b in raw:
        h, run = (h * 2 + gear[b]) % 65_536, 0 if b in blanks else run + 1
        hashes.append(h)
        since.append(run)
    at, last = [0], None
    for i in range(1, n):
        if raw[i] & 0xC0 == 0x80 or raw[i] in blanks:
            continue
        word = raw[i - 1] in blanks[:-1] and hashes[i - 1] < 65_536 // chunks.ONE_IN
        if word or (since[i - 1] >= chunks.DENSE_AFTER and hashes[i - 1] < 65_536 // chunks.DENSE_ONE_IN):
            if last is None or i - last >= chunks.LEAST_BYTES:
                at.append(i)
            last = i
    for s, e in list(zip(at, [*at[1:], n])):
        while e - s > chunks.MOST_BYTES:
            s = min((i for i in range(s + chunks.MOST_BYTES // 2, s + chunks.MOST_BYTES) if raw[i] & 0xC0 != 0x80), key=lambda i: (hashes[i - 1], i))
            at.append(s)
    return sorted(at)


def spans_by_force(rows):
    """Windows over the chunks of each text by a loop, their first occurrences by a dictionary of their bytes."""
    texts = sorted({(d, t) for d, t in rows if t}, key=lambda x: (x[0] is not None, x[0] or 0))
    windows = {}
    for x in texts:
        raw = x[1].encode()
        at, out = chunks_by_force(raw), []
        ends = [*at[1:], len(raw)]
        for k, s in enumerate(at):
            e = next((e for e in ends[k:] if len(raw[s:e].split()) >= chunks.RUN_WORDS or e - s >= chunks.RUN_BYTES), None)
            if e:
                out.append((s, e))
        s = next((s for s in at[::-1] if len(raw[s:].split()) >= chunks.RUN_WORDS or len(raw) - s >= chunks.RUN_BYTES), None)
        out = sorted({*out, (s, len(raw))}) if s is not None else out
        windows[x] = out
    first, found = {}, {}
    for x in texts:
        raw, spans = x[1].encode(), []
        for s, e in windows[x]:
            of, at = first.setdefault(raw[s:e], (x, s))
            if (of, at) == (x, s):
                continue
            s = max(s, at + e - s) if of == x else s
            if spans and s <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(e, spans[-1][1]))
            else:
                spans.append((s, e))
        if spans:
            found[x[0]] = spans
    return found


def found_spans(docs):
    return {r.doc_id: list(zip(r.starts, r.ends)) for r in chunks.repeated_spans(docs).collect()}


def test_spans(spark):
    passage, other = words(60, 1), words(80, 2)
    texts = [words(50, 10) + " " + passage + " " + words(40, 11), passage, words(30, 12) + "\n" + passage, words(70, 13), other + " ž " + words(20, 14) + " " + other, "ß" * 3_000, "ß" * 3_000, words(8, 15), words(8, 15), "x " * 900]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = found_spans(docs)
    assert got == spans_by_force(list(enumerate(texts)))
    assert set(got) == {1, 2, 4, 5, 6, 9}
    assert sum(e - s for s, e in got[6]) > 5_900 and all(s > 0 for s, _ in got[5] + got[9])
    for doc_id, text in ((1, passage), (2, passage), (4, other)):
        cut = sum(len(texts[doc_id].encode()[s:e].split()) for s, e in got[doc_id])
        assert cut >= len(text.split()) - 35
    pairs = {r.doc_id: r.first_ids for r in chunks.repeated_spans(docs).collect()}
    assert pairs[1] == [0] and pairs[2][0] == 0 and pairs[4] == [4]


def han(n, seed):
    r = random.Random(seed)
    return "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(n))


@pytest.mark.parametrize("sign", ["", "\u3000", "\u00a0"])
def test_texts_without_white_space(spark, sign):
    """A passage that other texts have at other places is cut from all but one, in texts that no ASCII white space divides."""
    passage = sign.join(han(8, 100 + k) for k in range(40))
    texts = [han(57, 1) + passage + han(31, 2), han(200, 3) + passage, passage + han(90, 4), han(400, 5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found_spans(docs) == spans_by_force(list(enumerate(texts)))
    left = {r.doc_id: r.text for r in chunks.cut_repeated_passages(docs.withColumn("n_chars", F.lit(0))).collect()}
    assert left[0] == texts[0] and left[3] == texts[3]
    for d in (1, 2):
        assert len(left[d]) < len(texts[d]) - 0.65 * len(passage)


def test_common_phrases_are_no_passage(spark):
    """Phrases that each occur elsewhere, but nowhere in this order, stay."""
    phrases = [words(9, 500 + k) for k in range(12)]
    texts = [words(20, 600 + k) + " " + p + " " + words(20, 700 + k) for k, p in enumerate(phrases)] + [" ".join(phrases)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found_spans(docs) == {}


def test_spans_of_test_documents(spark):
    docs = table(spark, DATA, "documents")
    assert found_spans(docs) == spans_by_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_an_insertion_moves_no_boundary_further_on():
    def bounds(text):
        data = np.frombuffer(text.encode() + bytes(chunks.GEAR_BYTES), dtype=np.uint8)
        return {len(text.encode()) - int(b) for b in chunks.chunk_bounds(data, np.array([0]), np.array([len(text.encode())]))[1]}

    text = words(400, 5)
    moved = bounds(text) ^ bounds("inserted words " + text)
    assert all(m > len(text) - 200 for m in moved)


def test_cutting(odd_docs, no_docs, spark):
    left = chunks.cut_repeated_passages(odd_docs)
    assert left.schema == odd_docs.schema
    assert Counter(r.doc_id for r in left.collect()) == Counter(r.doc_id for r in odd_docs.collect())
    assert chunks.cut_repeated_passages(no_docs).count() == 0
    passage = words(100, 3)
    docs = spark.createDataFrame([doc(1, passage), doc(2, words(20, 4) + " " + passage), doc(3, passage), doc(4, LONG), doc(5, LONG), doc(6, LONG + " " + words(30, 6))], DOCS)
    got = {r.doc_id: r for r in chunks.cut_repeated_passages(docs).collect()}
    assert got[1].text == passage and got[4].text == LONG
    assert 3 not in got and 5 not in got
    assert len(got[2].text.split()) < 50 and got[2].n_chars == len(got[2].text)
    assert got[6].text.split()[-20:] == words(30, 6).split()[-20:] and len(got[6].text) < 400


def test_texts_that_share_an_id(spark):
    """A passage at the same place in two texts without an id, whose hashes agree in the last eleven bits, is found and cut from one."""
    from xxhash import xxh64_intdigest

    passage, seen = words(60, 21), {}
    for n in range(10_000):
        text = f"{passage} žluť {words(12, 1_000 + n)}"
        other = seen.setdefault(xxh64_intdigest(text.encode(), 42) & 0x7FF, text)
        if other != text:
            break
    docs = spark.createDataFrame([(None, text), (None, other), (None, words(50, 22))], "doc_id long, text string").repartition(2)
    (span,) = chunks.repeated_spans(docs).collect()
    assert span.doc_id is None and span.cut_bytes >= 120
    left = {r.text for r in chunks.cut_repeated_passages(docs).collect()}
    assert len(left & {text, other}) == 1 and words(50, 22) in left
    (short,) = left - {text, other, words(50, 22)}
    assert any(full.endswith(short[-60:]) for full in (text, other)) and len(short.split()) <= 73 - 25


# --- mixing -----------------------------------------------------------------------------------------------------------------------


def targets_by_force(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, stopped, target = {s: weights[i % 3] for i, s in enumerate(names)}, set(), {}
    while True:
        left = share * sum(sizes.values()) - most * sum(sizes[s] for s in stopped)
        rest = [s for s in names if s not in stopped]
        target = {s: float(most * sizes[s]) for s in stopped} | {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = {s for s in rest if target[s] > most * sizes[s]}
        if not over:
            return target
        stopped |= over


@pytest.mark.parametrize("name", ["table", "odd"])
def test_mix(spark, odd_docs, name):
    docs = table(spark, DATA, "documents") if name == "table" else odd_docs
    rows = mixing.copies(docs).collect()
    want = Counter((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.source) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.source) for r in rows) == want
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.n_copies * r.size
        assert 0 <= r.n_copies <= 2
    target = targets_by_force(sizes)
    largest = {s: max(r.size for r in rows if r.source == s) for s in sizes}
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 2 * largest[s] + 1
    again = mixing.copies(docs.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    drawn = Counter()
    for r in rows:
        drawn[r.doc_id, r.source] += r.n_copies
    assert Counter((r.doc_id, r.source) for r in mixed.collect()) == +drawn


def test_mix_of_nothing(spark, no_docs):
    assert mixing.copies(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0
    blank = spark.createDataFrame([doc(1, ""), doc(2, None, None)], DOCS)
    assert [(r.target, r.n_copies) for r in mixing.copies(blank).collect()] == [(0, 0), (0, 0)]


# --- BPE --------------------------------------------------------------------------------------------------------------------------


def test_bpe(spark, odd_docs, no_docs):
    own = bpe.codec()
    for docs in (table(spark, DATA, "documents"), odd_docs, no_docs):
        decoded = bpe.decode(bpe.encode(docs))
        assert bpe.digests(decoded).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        want = Counter()
        for r in docs.collect():
            ids = np.array(own._own.encode_ordinary(r.text or ""), dtype="<u4")
            want[r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
        assert Counter(map(tuple, bpe.digests(decoded).collect())) == want


def test_bpe_joins_at_any_border(monkeypatch):
    monkeypatch.setattr(bpe, "LEAF", 16)
    monkeypatch.setattr(bpe, "WINDOW", 4)
    own, r = bpe.codec(), random.Random(2)
    parts = [" ", "  ", "\n", "'", "s", "ll", "a", "the", "héllo", "1", "23", "!", "$$$", "é", "中", "\t", " \n ", "\u3000", "\x1c", "\u2003", "x" * 30, "😀", "'re"]
    for _ in range(4_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 120)))
        ids = own.encode(text)
        assert ids.tolist() == own._own.encode_ordinary(text), repr(text)
        assert own.decode(ids) == text.encode()


# --- shards -----------------------------------------------------------------------------------------------------------------------


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 20_000)).astype(np.uint64)
    index = shards.PerfectHash.of(keys)
    assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))
    assert len(index.bits) * 64 < 5 * len(keys)
    with pytest.raises(ValueError):
        shards.PerfectHash.of(np.array([5, 5], dtype=np.uint64))
    assert shards.PerfectHash.of(keys[:0]).slots(keys[:3]).tolist() == [-1] * 3


@pytest.mark.parametrize("name", ["table", "odd", "none"])
def test_shards(spark, odd_docs, no_docs, name):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = {"table": table(spark, DATA, "documents"), "odd": odd_docs, "none": no_docs}[name]
    own, path = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), new_folder(spark, "ids")
    shards.write_shards(docs, path, shard_ids=20_000, shard_docs=50)
    if name == "none":
        assert spark.read.schema("part long").parquet(path).count() == 0
        return
    got = sorted(((r.start, r.key, r.n_tokens, r.ids_crc32) for r in shards.read_index(spark, path).collect()), key=lambda g: g[0])
    rows = docs.collect()
    ids = [np.array([*own.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4") for r in rows]
    assert Counter(g[1:] for g in got) == Counter((r.doc_id, len(i), crc32(i.tobytes())) for r, i in zip(rows, ids))
    assert [g[0] for g in got] == np.cumsum([0, *[g[2] for g in got]])[:-1].tolist()
    assert [g[1] for g in got] == sorted((r.doc_id for r in rows), key=lambda x: (x is not None, x))
    ask = [r.doc_id for r in rows if r.doc_id is not None][:60]
    want = Counter((r.doc_id, tuple(i.tolist())) for r, i in zip(rows, ids) if r.doc_id in ask)
    found = shards.look_up(spark, path, [*ask, 1 << 40, -5])
    assert Counter((r.doc_id, tuple(r.ids)) for r in found.collect()) == want
    assert shards.look_up(spark, path, [1 << 40]).count() == 0


def test_ids_over_several_shards(spark):
    """One id on a third of the rows, none on some, and the least of all ids."""
    ids = [7] * 90 + [None] * 60 + [-(1 << 63)] * 2 + list(range(100, 220))
    docs = spark.createDataFrame([(d, f"text {i}") for i, d in enumerate(ids)], "doc_id long, text string")
    path = new_folder(spark, "ids")
    shards.write_shards(docs, path, shard_docs=16)
    got = shards.read_index(spark, path).collect()
    assert Counter(r.key for r in got) == Counter(ids) and len({r.start for r in got}) == len(ids)
    found = Counter(r.doc_id for r in shards.look_up(spark, path, [7, -(1 << 63), 150, 5]).collect())
    assert found == {7: 90, -(1 << 63): 2, 150: 1}


def test_pieces_are_those_of_the_library():
    own, r = shards.tokenizer(None), random.Random(4)
    parts = [" ", "  ", "\n", "'", "s", "'ll", "a", "The", "héllo", "1", "²", "!", "§$%", "\xa0", "\x85", "\t", "\x1c", "ɏ", "ɐ", "中", "<|endoftext|>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(3_000)]
    want = [own.packed(e.ids) for e in own._own.encode_batch(texts, add_special_tokens=False)]
    assert own.encode(texts) == want

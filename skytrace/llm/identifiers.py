"""Personal data by bootstrapped contextual extraction.

Fixed patterns find e-mail addresses, IP numbers, card numbers and phone numbers: the seeds. What surrounds and shapes them gives lexical
patterns: the form of the identifier (its digits counted, the rest as written), the word before it and the word behind it. Every other
stretch that might be an identifier of a kind, and passes that kind's own checks, is a candidate. Patterns and instances make a
graph, on which Spark reckons in rounds: a pattern is trusted by the share of what it extracts that is known, over all occurrences of
its word in the corpus or of its form among candidates; an instance by the trusted patterns that extract it. Candidates that become
trusted are found, wherever they stand, and count as known in the next round.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytrace.llm.common import few_at_once, written

#: The kinds, in the order of the contract.
KINDS = ("email", "ip", "card", "phone")
#: A pattern is trusted from so many different known instances and from this share of what it extracts; an instance from this
#: confidence; rounds of scoring.
LEAST_INSTANCES, PATTERN_FROM, INSTANCE_FROM, ROUNDS = 4, 0.8, 0.8, 3
#: Tokens of a candidate; characters in which its neighbours are looked for; words counted before they are handed on; parts that a
#: hot pattern or instance is dealt to.
MOST_TOKENS, NEAR, WORDS, SALTS = 4, 48, 1 << 17, 32
_SLICE = 1 << 20

# The contract's patterns, written so that no text makes them look at a character over and over.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    """Whether the check digit fits."""
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + doubled) % 10 == 0


def _is_byte(part: str) -> bool:
    bare = part.lstrip("0")
    return len(bare) < 3 or (len(bare) == 3 and bare <= "255")


def _passes(kind: int, shown: str) -> bool:
    """The checks of a kind on what stands in the text."""
    if kind == 0:
        return True
    if kind == 1:
        return all(map(_is_byte, re.split(r"[^0-9]+", shown)))
    digits = _NOT_DIGITS.sub("", shown)
    return (12 <= len(digits) <= 19 and luhn(digits)) if kind == 2 else 9 <= len(digits) <= 15


def base_spans(text: str) -> list[Span]:
    """What the fixed patterns find, leftmost and without overlap within each kind, by start and kind; a match that fails its checks goes."""
    out, done, at = [], 0, 0
    for m in _DOMAIN.finditer(text):
        # The longest run before the @ that began behind the last match and the last @.
        low = max(done, text.rfind("@", at, m.start()) + 1)
        before = text[max(low, at) : m.start()]
        local = len(before) - len(before.rstrip(_LOCAL))
        at = m.start()
        if local:
            done = m.end()
            out.append((m.start() - local, 0, done))
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if _passes(kind, m[0])]
    return sorted(out)


# --- candidates -------------------------------------------------------------------------------------------------------------------

_DIGITS_ON = re.compile(r"[0-9]\S*")
_NUMBER = re.compile(r"[+(]?[0-9](?:[0-9().+/-]*[0-9])?\)?|\([0-9]+\)")
_FOUR = re.compile(r"[0-9]{1,3}(?:([.,/_-])[0-9]{1,3})(?:\1[0-9]{1,3}){2}")
_LEFT, _RIGHT = "\"'#*$%&!,;:.?<>[]{}=_|~-/)\\", "\"'#*$%&!,;:.?<>[]{}=_|~-/(+\\"
#: An address as people spell it out.
_SPELT = re.compile(r"(?:\x20?[\[({]at[\])}]\x20?|\x20at\x20|@)[A-Za-z0-9-]++(?:(?:\x20?[\[({]dot[\])}]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]++)+", re.IGNORECASE)


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """[start, end) of the tokens that hold digits."""
    done = 0
    for m in _DIGITS_ON.finditer(text):
        gap = text[done : m.start()]
        start = m.start() if not gap or gap[-1].isspace() else m.start() - len(gap.rsplit(None, 1)[-1])
        yield start, m.end()
        done = m.end()


def _bare(text: str, start: int, end: int) -> tuple[int, int]:
    """A token without the marks around it."""
    token = text[start:end]
    left = len(token) - len(token.lstrip(_LEFT))
    return start + left, max(start + left, start + len(token.rstrip(_RIGHT)))


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Stretches that may be identifiers of a kind, pass its checks and touch no base span: one to MOST_TOKENS neighbouring tokens of
    numbers, four short numbers between equal marks, and addresses spelt out."""
    out, row, ended = [], [], -1
    for start, end in _tokens(text):
        lo, hi = _bare(text, start, end)
        shown = text[lo:hi]
        # A row of tokens goes on where nothing but one blank stands between.
        row = row if row and lo == start and ended + 1 == start and text[ended] == " " else []
        ended = end if hi == end else -1
        if _FOUR.fullmatch(shown) and _passes(1, shown):
            out.append((lo, 1, hi))
        if len(shown) > 40 or not _NUMBER.fullmatch(shown):
            row = []
            continue
        row = [*row[-MOST_TOKENS + 1 :], lo]
        for first in row:
            whole = text[first:hi]
            out += [(first, kind, hi) for kind in (2, 3) if _passes(kind, whole) and (kind == 3 or not whole.strip("0123456789 -"))]
    for m in _SPELT.finditer(text):
        before = text[max(0, m.start() - 64) : m.start()]
        local = len(before) - len(before.rstrip(_LOCAL))
        if local:
            out.append((m.start() - local, 0, m.end()))
    starts, ends = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    touched = lambda start, end: (k := bisect_left(starts, end)) > 0 and ends[k - 1] > start
    return sorted(x for x in out if not touched(x[0], x[2]))


def instance(kind: int, shown: str) -> str:
    """What is the same identifier, however it is written."""
    if kind == 0:
        return re.sub(r"\s*[\[({]?\bdot\b[\])}]?\s*", ".", re.sub(r"\s*[\[({]?\bat\b[\])}]?\s*", "@", shown.lower(), count=1))
    return ".".join(p.lstrip("0") or "0" for p in re.split(r"[^0-9]+", shown)) if kind == 1 else _NOT_DIGITS.sub("", shown)


def form(kind: int, shown: str) -> str:
    """Runs of digits by their length, those of letters as one letter, all else as written; in addresses and IP numbers without lengths."""
    if kind == 0:
        spelt = re.sub(r"\bdot\b", "..", re.sub(r"\bat\b", "@@", shown.lower()))
        return re.sub(r"[0-9a-z]+", "a", spelt)[:NEAR]
    if kind == 1:
        return re.sub(r"[0-9]+", "9", shown)
    return re.sub(r"[0-9]+", lambda m: f"9{{{len(m[0])}}}", shown)


def patterns(text: str, span: Span) -> list[str]:
    """The patterns that extract a span: its form, and the words beside it where they hold no digit."""
    start, kind, end = span
    before, behind = text[max(0, start - NEAR) : start].lower().split(), text[end : end + NEAR].lower().split()
    out = ["f " + form(kind, text[start:end])]
    for mark, words in (("l ", before[-1:]), ("r ", behind[:1])):
        out += [mark + w for w in words if not re.search("[0-9]", w)]
    return out


def _words(text: str) -> Iterator[str]:
    """Words in lower case, some at a time, so that a long text is never held twice over."""
    low, n = text.lower(), 0
    while n < len(low):
        stop = min(n + _SLICE, len(low))
        while stop < len(low) and not low[stop].isspace():
            stop += 1
        yield from low[n:stop].split()
        n = stop


_FOUND = "kind int, row long, doc_id {0}, base array<struct<start:int,kind:int,end:int>>, told array<struct<start:int,kind:int,end:int,known:boolean,instance:string,patterns:array<string>>>, word string, n long"
_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_TOLD = pa.struct([*_SPAN, ("known", pa.bool_()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])


def _found_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0 for documents, of kind 1 for words and how often they occur."""
    names, counts = ["kind", "row", "doc_id", "base", "told", "word", "n"], Counter()

    def counted(kind_of_id: pa.DataType) -> pa.RecordBatch:
        n = len(counts)
        out = [pa.array([1] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, kind_of_id), pa.nulls(n, pa.list_(_SPAN)), pa.nulls(n, pa.list_(_TOLD)), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
        counts.clear()
        return pa.RecordBatch.from_arrays(out, names)

    kind_of_id = None
    for batch in batches:
        kind_of_id = batch.schema.field("doc_id").type
        for at in range(0, batch.num_rows, 128):
            part, bases, told = batch.slice(at, 128), [], []
            for text in part.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                bases.append([dict(zip(("start", "kind", "end"), s)) for s in base])
                spans = [(s, True) for s in base] + [(s, False) for s in candidates(text, base)]
                told.append([{"start": s[0], "kind": s[1], "end": s[2], "known": known, "instance": instance(s[1], text[s[0] : s[2]]), "patterns": patterns(text, s)} for s, known in spans])
                counts.update(_words(text))
                if len(counts) > WORDS:
                    yield counted(kind_of_id)
            n = part.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), part.column("row"), part.column("doc_id"), pa.array(bases, pa.list_(_SPAN)), pa.array(told, pa.list_(_TOLD)), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], names)
    if counts:
        yield counted(kind_of_id)


# --- the graph --------------------------------------------------------------------------------------------------------------------


def _salted(df: DataFrame) -> DataFrame:
    """df once per salt, to be met by rows that are dealt to salts: both sides of a hot key are spread."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _salt(*by: str) -> F.Column:
    return F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int").alias("salt")


def trusted(told: DataFrame, words: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, instance, confidence) of instances that are not known but become trusted, from occurrences (kind, instance, known,
    patterns) and (word, n).

    In each round a pattern's share is the confidence of what it extracts, summed over occurrences, to all it extracts and one more:
    of a form, its candidates; of a word, all its occurrences in the corpus. Instances that count must be different ones, so copies of
    one text make no pattern. An instance has the confidence that not all trusted patterns that extract it are wrong.
    """
    # Occurrences of the same instance under the same pattern are one edge; no hot pattern or instance is gathered anywhere.
    edges = written(told.select("kind", "instance", F.explode("patterns").alias("pattern"), "known").groupBy("kind", "instance", "pattern").agg(F.count("*").alias("n"), F.max("known").alias("known")), "edges")
    nodes = written(edges.groupBy("kind", "instance").agg(F.max("known").alias("known")).withColumn("confidence", F.col("known").cast("double")), "instances")
    seeds = edges.groupBy("kind", "pattern").agg(F.sum("n").alias("extracted"))
    # Words in patterns only, each with its occurrences in the corpus, which are at least as many as it extracts.
    beside = seeds.where("pattern not like 'f %'").withColumn("word", F.substring("pattern", 3, 1 << 30))
    often = beside.join(words.groupBy("word").agg(F.sum("n").alias("occurs")), "word", "left").select("kind", "pattern", F.greatest("extracted", F.coalesce("occurs", F.lit(0))).alias("extracted"))
    totals = written(often.unionByName(seeds.where("pattern like 'f %'")), "totals")
    for _ in range(rounds):
        share = edges.select("kind", "instance", "pattern", "n").join(nodes, ["kind", "instance"]).groupBy("kind", "pattern").agg(F.sum(F.col("n") * F.col("confidence")).alias("hits"), F.count_if(F.col("confidence") >= INSTANCE_FROM).alias("instances"))
        sure = F.col("hits") / (F.col("extracted") + 1)
        good = share.where(F.col("instances") >= LEAST_INSTANCES).join(totals, ["kind", "pattern"]).select("kind", "pattern", sure.alias("sure")).where(F.col("sure") >= PATTERN_FROM)
        open_ = edges.where("not known").select("kind", "instance", "pattern", _salt("instance"))
        wrong = F.exp(F.sum(F.log(1 - F.least("sure", F.lit(1 - 1e-9)))))
        raised = open_.join(_salted(good), ["kind", "pattern", "salt"]).groupBy("kind", "instance").agg((1 - wrong).alias("raised"))
        nodes = written(nodes.join(raised, ["kind", "instance"], "left").select("kind", "instance", "known", F.when(F.col("known"), 1.0).otherwise(F.coalesce("raised", F.lit(0.0))).alias("confidence")), "instances")
    # A candidate of an instance that is known from elsewhere is found at once.
    return nodes.where(F.col("confidence") >= INSTANCE_FROM).select("kind", "instance", "confidence")


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of overlapping spans the surest stays, then the longest, then the first."""
    for batch in batches:
        out = []
        for found in batch.column("found").to_pylist():
            kept: list[dict] = []
            for one in sorted(found, key=lambda x: (-x["confidence"], x["start"] - x["end"], x["start"], x["kind"])):
                if not any(one["start"] < k["end"] and k["start"] < one["end"] for k in kept):
                    kept.append({k: one[k] for k in ("start", "kind", "end")})
            out.append(kept)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.list_(_SPAN))], ["row", "added"])


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added): for each document the spans (start, kind, end) of the fixed patterns, and those that the bootstrapping
    adds; kind is a place in KINDS, start and end count code points. Both lists are in order of start, then kind, and no added span
    overlaps a base one.

    Null and empty texts have none. Rows are searched on their own and kept as they are, so ids may repeat or be null; other columns
    are left out. Copies of a text add nothing to the trust in a pattern. Texts may have any length; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = few_at_once(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    all_found = written(source.mapInArrow(_found_batches, _FOUND.format(kind)), "identifiers")
    found, words = all_found.where("kind = 0").select("row", "doc_id", "base", "told"), all_found.where("kind = 1").select("word", "n")
    told = found.select("row", F.explode("told").alias("t")).select("row", "t.*")
    sure = trusted(told, words)
    open_ = told.where("not known").select("row", "start", "kind", "end", "instance", _salt("row"))
    more = open_.join(_salted(sure), ["kind", "instance", "salt"]).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end", "confidence")).alias("found"))
    added = more.mapInArrow(_chosen, "row long, added array<struct<start:int,kind:int,end:int>>")
    both = found.select("row", "doc_id", "base").join(added, "row", "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return both.select("doc_id", "base", F.array_sort(F.coalesce("added", none)).alias("added"))

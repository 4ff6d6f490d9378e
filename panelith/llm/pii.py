"""Personal data: base patterns and bootstrapped contextual extraction.

Base patterns find e-mail addresses, IP addresses, card and phone numbers by contract. They are the seeds of a bootstrap. Each seed and each
other token with a digit or with a sign of identifiers inside is an occurrence with up to three lexical patterns: the two words before it, the
word before and the word behind it, and the two words behind it. Spark scores the graph of patterns and instances iteratively: a pattern's confidence
for a kind is the mean score of its instances, where a known instance counts 1 for its own kind, and an unknown one the mean confidence of its *other*
patterns, so that no pattern vouches for itself. A pattern that enough different known instances support and whose confidence passes the
threshold discovers the unknown instances that stand in it. These are known in the next round and support further patterns, until a round
finds none: each makes more instances known, so there is a last one. Added are the occurrences in passing patterns; base spans stay as they are.

All spans are in code points, end exclusive. Texts are matched whole and in linear time, however long the runs in them.

Edge cases: a null or empty text has no spans; repeated rows give repeated results; null ids are kept; an empty table gives no
rows; further columns are ignored. A token that overlaps a base span is never added again.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# The kinds in order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Tokens that hold a digit or a sign of identifiers.
MARKS = "0123456789@_([{=/\\"
NUMBERED = re.compile(r"(?<!\S)[^\s0-9@_(\[{=/\\]*+[0-9@_(\[{=/\\]\S*+")
WORD = re.compile(r"\S+")
TRIM = ".,;:!?\"'()[]{}<>|*#%&$"

#: How often the graph is scored in each round, how many known instances a pattern needs, and how sure it must be.
SCORINGS, LEAST_SEEDS, CONFIDENCE = 3, 5, 0.8
#: Characters of a neighbouring word that a pattern holds, those next to the span.
CONTEXT = 64


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, found from the @ signs: linear even in long runs without one."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        head = text[last:at]
        start = last + len(head.rstrip(LOCAL))
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)
    return out


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    if not text:
        return []
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 38 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def describe(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


class _Words:
    """The words of a text, cut at blanks once; neighbours of a span are read from at most ``CONTEXT`` characters each."""

    def __init__(self, text: str):
        self.text = text
        self.starts, self.ends = [], []
        for m in WORD.finditer(text):
            self.starts.append(m.start())
            self.ends.append(m.end())

    def _before(self, start: int) -> Iterator[str]:
        """Words before a span, the nearest first: what its own word has before it, if more than signs, then whole words."""
        text, k = self.text, bisect_left(self.starts, start) - 1
        if k >= 0 and self.ends[k] >= start:
            own = text[max(self.starts[k], start - CONTEXT) : start].rstrip(TRIM)
            if own:
                yield own
            k -= 1
        while k >= 0:
            yield text[max(self.starts[k], self.ends[k] - CONTEXT) : self.ends[k]]
            k -= 1

    def _behind(self, end: int) -> Iterator[str]:
        """Whole words behind the word that a span ends in."""
        for k in range(bisect_left(self.starts, end), len(self.starts)):
            yield self.text[self.starts[k] : min(self.ends[k], self.starts[k] + CONTEXT)]

    def around(self, start: int, end: int) -> list[str]:
        """The patterns of a span: two words before it, one before and one behind, two behind; without their punctuation."""
        left = [w.lower().strip(TRIM) for w in itertools.islice(self._before(start), 2)][::-1]
        right = [w.lower().strip(TRIM) for w in itertools.islice(self._behind(end), 2)]
        out = []
        if len(left) == 2 and all(left):
            out.append("<<" + " ".join(left))
        if left and right and left[-1] and right[0]:
            out.append(f"<>{left[-1]} {right[0]}")
        if len(right) == 2 and all(right):
            out.append(">>" + " ".join(right))
        return out


def occurrences(text: str | None, base: list[tuple[int, int, int]]) -> list[tuple[int, int, list[str], str, int]]:
    """(start, end, patterns, instance, kind or -1) of the seeds and of the other tokens that may be identifiers."""
    if not text:
        return []
    numbered = list(NUMBERED.finditer(text))
    if not base and not numbered:
        return []
    words = _Words(text)
    out = [(s, e, words.around(s, e), text[s:e].lower(), k) for s, k, e in base]
    n, reach = 0, 0
    for m in numbered:
        raw = m[0]
        start = m.start() + len(raw) - len(raw.lstrip(TRIM))
        end = m.end() - (len(raw) - len(raw.rstrip(TRIM)))
        while n < len(base) and base[n][0] < start:
            reach = max(reach, base[n][2])
            n += 1
        if start < end and reach <= start and not (n < len(base) and base[n][0] < end) and any(c in MARKS for c in text[start:end]):
            out.append((start, end, words.around(start, end), text[start:end].lower(), -1))
    return [x for x in out if x[2]]


SCAN_SCHEMA = "doc_id long, text_hash long, n_email long, n_ip long, n_card long, n_phone long, base string, found array<struct<start: long, end: long, patterns: array<long>, instance: long, kind: int>>"
_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("patterns", pa.list_(pa.int64())), ("instance", pa.int64()), ("kind", pa.int32())]))


def _key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = cell.as_py() or ""
            base = base_spans(text)
            counts = [sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))]
            found = [{"start": s, "end": e, "patterns": [_key(x) for x in p], "instance": _key(i), "kind": k} for s, e, p, i, k in occurrences(text, base)]
            rows.append((doc_id, _key(text), *counts, describe(base), found))
        types = (*[pa.int64()] * 6, pa.string(), _FOUND)
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "text_hash", "n_email", "n_ip", "n_card", "n_phone", "base", "found"])


def scan(docs: DataFrame) -> DataFrame:
    """Base spans and occurrences of every row."""
    common.prepare(docs.sparkSession)
    return common.pick(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, SCAN_SCHEMA)


def graph(scanned: DataFrame) -> DataFrame:
    """The edges (pattern, instance, kind or -1), each once, however many copies hold it. A base kind of an instance holds wherever it stands."""
    each = scanned.select(F.explode("found").alias("f")).select(F.explode("f.patterns").alias("pattern"), "f.instance", "f.kind")
    return each.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"))


def confidences(edges: DataFrame, scorings: int = SCORINGS, least_seeds: int = LEAST_SEEDS) -> DataFrame | None:
    """(pattern, kind, confidence) of the patterns with enough known instances of the kind, or None if there are none."""
    known = edges.where("kind >= 0").groupBy("pattern", "kind").agg(F.count("*").alias("sure")).where(F.col("sure") >= least_seeds)
    known = common.materialize(known, "known")
    if not known.take(1):
        common.discard(known)
        return None
    size = edges.join(known.select("pattern").distinct(), "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("size"))
    known_sized = common.materialize(known.join(size, "pattern"), "known")
    unknown = edges.where("kind < 0").join(known.select("pattern").distinct(), "pattern", "left_semi").select("pattern", "instance")
    # a pattern without confidence for a kind counts as zero: the mean is over all of an instance's patterns in the graph
    degree = edges.where("kind < 0").groupBy("instance").agg(F.count("*").alias("degree"))
    unknown = common.materialize(unknown.join(degree, "instance").where("degree > 1"), "unknown")
    scores = known_sized.select("pattern", "kind", (F.col("sure") / F.col("size")).alias("confidence"))
    for _ in range(scorings - 1):
        votes = unknown.join(scores, "pattern")
        total = votes.groupBy("instance", "kind").agg(F.sum("confidence").alias("total"))
        others = unknown.join(total, "instance").join(scores.withColumnRenamed("confidence", "own"), ["pattern", "kind"], "left")
        gain = others.groupBy("pattern", "kind").agg(F.sum((F.col("total") - F.coalesce("own", F.lit(0.0))) / (F.col("degree") - 1)).alias("gain"))
        raised = known_sized.join(gain, ["pattern", "kind"], "left")
        new = common.materialize(raised.select("pattern", "kind", ((F.col("sure") + F.coalesce("gain", F.lit(0.0))) / F.col("size")).alias("confidence")), "confidence")
        common.discard(scores)
        scores = new
    common.discard(unknown, known) if scorings > 1 else None
    return scores


def patterns(scanned: DataFrame, rounds: int | None = None, scorings: int = SCORINGS, least_seeds: int = LEAST_SEEDS, confidence: float = CONFIDENCE) -> DataFrame:
    """(pattern, as_kind, confidence) of the patterns that pass in the last round (of ``rounds``, if given); what passed before still does, as known instances only grow."""
    spark = scanned.sparkSession
    edges = common.materialize(graph(scanned), "edges")
    passed = spark.createDataFrame([], "pattern long, as_kind int, confidence double")
    for _ in itertools.count() if rounds is None else range(rounds):
        scores = confidences(edges, scorings, least_seeds)
        if scores is None:
            break
        sure = scores.where(F.col("confidence") >= confidence).groupBy("pattern").agg(F.max(F.struct("confidence", -F.col("kind"))).alias("best"))
        now = common.materialize(sure.select("pattern", (-F.col("best.col2")).cast("int").alias("as_kind"), "best.confidence"), "patterns")
        votes = edges.where("kind < 0").join(now, "pattern").groupBy("instance").agg(F.max(F.struct("confidence", -F.col("as_kind"))).alias("best"))
        found = common.materialize(votes.select("instance", (-F.col("best.col2")).cast("int").alias("as_kind")), "discovered")
        passed = now
        if not found.take(1):
            break
        grown = edges.join(found, "instance", "left").select("pattern", "instance", F.coalesce("as_kind", "kind").alias("kind"))
        before, edges = edges, common.materialize(grown, "edges")
        common.discard(before, found)
    common.discard(edges)
    return passed


def added_spans(scanned: DataFrame, passing: DataFrame) -> DataFrame:
    """(doc_id, text_hash, added): the spans that the patterns add, for the texts that have any; the surest pattern names the kind."""
    other = scanned.select("doc_id", "text_hash", F.explode("found").alias("f")).where("f.kind < 0")
    each = other.select("doc_id", "text_hash", "f.start", "f.end", F.explode("f.patterns").alias("pattern")).join(passing, "pattern")
    hits = each.groupBy("doc_id", "text_hash", "start", "end").agg(F.max(F.struct("confidence", -F.col("as_kind"))).alias("best"))
    span = F.struct("start", (-F.col("best.col2")).cast("int").alias("kind"), "end")
    return hits.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(span)).alias("added"))


def _same_text(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, spans of all, n_added."""
    scanned = common.materialize(scan(docs), "scanned")
    added = common.materialize(added_spans(scanned, patterns(scanned)), "added")
    rows = scanned.drop("found")
    named = F.array(*[F.lit(k) for k in KINDS])
    joined = rows.join(added, _same_text(rows, added), "left").select(rows["*"], "added")
    base = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.struct(F.split(x, ":")[1].cast("long").alias("start"), (F.array_position(named, F.split(x, ":")[0]) - 1).cast("int").alias("kind"), F.split(x, ":")[2].cast("long").alias("end")))
    every = F.array_sort(F.concat(base, F.col("added")))
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.element_at(named, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","))
    return joined.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"), F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"))


def mask_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, last = [], 0
    for s, k, e in sorted(spans):
        if s >= last:
            out += [text[last:s], f"[{KINDS[k].upper()}]"]
        last = max(last, e)
    return "".join(out) + text[last:]


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with base and added spans replaced in the text, and ``n_chars``, if there, counted anew."""
    common.prepare(docs.sparkSession)
    scanned = common.materialize(scan(docs), "scanned")
    added = common.materialize(added_spans(scanned, patterns(scanned)), "added")
    common.discard(scanned)
    names = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def masked(with_added: bool):
        def run(batches):
            for batch in batches:
                at = batch.schema.names.index("text")
                texts = batch.column(at).to_pylist()
                more = batch.column(batch.num_columns - 1).to_pylist() if with_added else [None] * len(texts)
                new = [t and mask_text(t, base_spans(t) + [(a["start"], a["kind"], a["end"]) for a in m or ()]) for t, m in zip(texts, more, strict=True)]
                cols = list(batch.columns[: len(names)])
                cols[at] = pa.array(new, type=pa.string())
                if "n_chars" in names:
                    n = names.index("n_chars")
                    cols[n] = pa.array([None if t is None else len(t) for t in new], type=pa.int64()).cast(batch.schema.types[n])
                yield pa.RecordBatch.from_arrays(cols, names=names)

        return run

    if not added.take(1):
        return docs.mapInArrow(masked(False), fields)
    key, its_id, its_key, more_spans = (common.free_name(names, x) for x in ("text_key", "its_id", "its_key", "added_spans"))

    def keyed(batches):
        for batch in batches:
            h = pa.array([_key(t.as_py() or "") for t in batch.column("text")], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, h], names=[*batch.schema.names, key])

    marked = docs.mapInArrow(keyed, f"{fields}, `{key}` long")
    held = added.select(F.col("doc_id").alias(its_id), F.col("text_hash").alias(its_key), F.col("added").alias(more_spans))
    joined = marked.join(held, F.col("doc_id").cast("long").eqNullSafe(F.col(its_id)) & (F.col(key) == F.col(its_key)), "left")
    return joined.select(*[F.col(f"`{c}`") for c in names], more_spans).mapInArrow(masked(True), fields)
